"""Upkeep of the vector log and of the text index against rebuilds."""

import random

import numpy as np
import pytest
from memspark.operators import knn, sparse
from memspark.sources import text_index
from memspark.sources.text_index import TextIndex
from memspark.sources.vector_log import VectorLog
from pyspark.sql import functions as F

V = "hash string, item_type string, embedding array<float>"


@pytest.mark.parametrize("seed", [1, 2])
def test_log_against_brute_force(spark, tmp_path, seed):
    """Adds, deletes, adds again, compactions in between: a hash keeps its first vector after its last tombstone."""
    r = random.Random(seed)
    log, want, history = VectorLog(spark, f"file://{tmp_path}/v", buckets=3), {}, []
    for k in range(9):
        some = {f"h{r.randrange(30)}": [float(k + 1), float(r.randrange(9))] for _ in range(12)}
        if k % 3 == 2:
            log.delete(spark.createDataFrame([(h,) for h in some] + [(None,), ("nobody",)], "hash string"))
            want = {h: v for h, v in want.items() if h not in some}
        else:
            odd = [("bad", "x", [float("nan"), 1.0]), ("none", "x", None), (None, "x", [1.0, 1.0]), ("long", "x", [1.0] * 3)]
            log.add(spark.createDataFrame([(h, "x", v) for h, v in some.items()] + odd, V), dim=2)
            want = {h: np.array(v) / np.linalg.norm(v) for h, v in some.items() if h not in want} | want
        history.append((log.s.version(), dict(want)))
        if k in (3, 6):
            log.compact()
            assert log._deltas() == []
        got = {x.hash: x.embedding for x in log.read().collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[h], want[h], atol=1e-6) for h in want)
    for version, then in history:
        assert {x.hash for x in log.read(version).collect()} == set(then)
    buckets = log.s.buckets_of("vector", spark.createDataFrame([("h1",)], "hash string"))
    assert {x.hash for x in log.read(buckets=buckets).collect()} <= set(want)
    log.compact()
    log.s.vacuum(1)
    assert {x.hash for x in log.read().collect()} == set(want)


def test_log_compaction_rule(spark, tmp_path):
    log = VectorLog(spark, f"file://{tmp_path}/v", buckets=4)
    log.add(spark.range(4000).select(F.concat(F.lit("h"), "id").alias("hash"), F.lit("x").alias("item_type"), F.array((F.col("id") + 1).cast("float"), F.lit(1.0).cast("float")).alias("embedding")))
    log.compact()
    log.delete(log.read().where("substring(hash, 2, 1) = '1'").select("hash"))
    assert log.deleted() == (4000, 1111) and not log.needs_compaction()
    log.delete(log.read().where("substring(hash, 2, 1) = '2'").select("hash"))
    assert log.needs_compaction() and log.read().count() == 4000 - 2222
    before = log.s.listing("vector")["buckets"]
    log.add(spark.createDataFrame([("new", "x", [1.0, 0.0])], V))
    log.compact()
    assert log.deleted() == (4000 - 2222 + 1, 0) and set(log.s.listing("vector")["buckets"]) == set(before)
    log.add(spark.createDataFrame([("newer", "x", [1.0, 0.0])], V))
    log.compact()
    again = log.s.listing("vector")["buckets"]
    assert len({x["path"].split("/")[1] for x in again.values()}) == 2  # one bucket is of the last commit


def corpus(r, n, words=400):
    return [" ".join(f"w{min(r.randrange(words), r.randrange(words))}" for _ in range(r.randint(0, 60))) for _ in range(n)]


def rows(df):
    return sorted(tuple(x) for x in df.select("term", "hash", "tf", "dl").collect())


@pytest.mark.parametrize("mode", ["word", "mixed"])
def test_index_equals_a_rebuild(spark, tmp_path, mode):
    r = random.Random(3)
    index, docs = TextIndex(spark, f"file://{tmp_path}/i", mode=mode, buckets=4), {}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "hash string, content string")
    for k in range(4):
        new = {f"d{r.randrange(40)}": t for t in corpus(r, 15)}
        gone = {f"d{r.randrange(40)}" for _ in range(6)} if k else set()
        index.update(frame(new), spark.createDataFrame([(x,) for x in gone], "hash string") if gone else None)
        docs = {h: t for h, t in docs.items() if h not in gone} | new
        if k == 2:
            index.update(None, spark.createDataFrame([("d1",), ("nobody",)], "hash string"))
            docs.pop("d1", None)
        now = frame(docs)
        want = sparse.postings(now, mode)
        assert rows(index.postings()) == rows(want)
        assert {tuple(x) for x in index.df().collect()} == {(x.term, x["count"]) for x in want.groupBy("term").count().collect()}
        assert index.size() == (len(docs), sum(x.tf for x in want.collect()))
        assert index.stale(now).count() == 0
    changed = {h: t for h, t in docs.items() if h != min(docs)} | {"zz": "new words"}
    assert {tuple(x) for x in index.stale(frame(changed)).collect()} == {(min(docs), "delete"), ("zz", "add")}
    before = rows(index.postings())
    index.compact()
    assert rows(index.postings()) == before and index.state()["dead"] == [] and len(index.state()["segments"]) == 1


def test_search_of_segments_equals_bm25(spark, tmp_path, monkeypatch):
    """Hot terms, dead documents, several segments, filters: the same rows and scores; and hot postings are passed over."""
    monkeypatch.setattr(text_index, "BLOCK", 8)
    r = random.Random(4)
    texts = {f"d{i:04d}": t + " the the" * r.randrange(1, 3) + (" rare%d" % (i % 30)) for i, t in enumerate(corpus(r, 500, 150))}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "hash string, content string")
    index = TextIndex(spark, f"file://{tmp_path}/i", buckets=3)
    items = sorted(texts.items())
    index.update(frame(dict(items[:300])))
    index.update(frame({h: t + " changed" for h, t in items[250:450]}))
    index.update(frame(dict(items[250:])), spark.createDataFrame([(h,) for h, _ in items[:20]], "hash string"))
    docs = frame(dict(items[20:]))
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["the rare3 w1", "the", "w0 w1 w2 w3 w4 w5 the", "nothing known", "", "rare1 rare2 rare3 w9 w10 the", texts["d0100"]])], "query_id int, text string")
    for k, seeds in ((5, 1), (20, 50), (1, 1)):
        want = {(x.query_id, x.hash): x.score for x in sparse.bm25(docs, q, k).collect()}
        got = {(x.query_id, x.hash): x.score for x in index.search(q, k, seeds=seeds).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-9 for x in want)
    may = docs.where("hash like '%7'").select("hash")
    want = {(x.query_id, x.hash) for x in sparse.bm25(docs, q, 5, live=F.col("hash").like("%7")).collect()}
    assert {(x.query_id, x.hash) for x in index.search(q, 5, keep=lambda df: df.join(may, "hash", "left_semi"), seeds=1).collect()} == want
    assert TextIndex(spark, f"file://{tmp_path}/empty").search(q).count() == 0
    assert knn.needs_compaction(10, 4) is False and index.needs_compaction(segments=2)


def _shuffled(spark) -> int:
    """Rows written to shuffles by the application so far."""
    jvm, sc = spark._jvm, spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_updates_shuffle_no_postings(spark, tmp_path, monkeypatch):
    """blocks are made where the forward rows lie; a hash that comes twice has its smallest content; what is dead is not read."""
    monkeypatch.setattr(text_index, "BLOCK", 4)
    monkeypatch.setattr(text_index, "ENTRIES", 90)
    r = random.Random(5)
    texts = {f"d{i:03d}": t for i, t in enumerate(corpus(r, 300, 200))}
    docs = spark.createDataFrame(sorted(texts.items()), "hash string, content string")
    n = sparse.postings(docs).count()
    index = TextIndex(spark, f"file://{tmp_path}/i", buckets=3)
    seen = _shuffled(spark)
    index.update(docs.unionByName(docs.limit(5).withColumn("content", F.lit("~ later"))))
    index.update(docs.where("hash < 'd150'"))
    assert _shuffled(spark) - seen < n
    state = index.state()
    blocks = index._parts(state, "blocks", text_index.BLOCKS)
    assert blocks.agg(F.max("n"), F.sum("n"), F.max("max_tf")).first()[:2] == (4, n + index._parts(state, "forward", text_index.FORWARD).where("segment = 1").agg(F.sum(F.size("terms"))).first()[0])
    want = sparse.postings(docs.where("hash >= 'd005'"))
    assert rows(index.postings().where("hash >= 'd005'")) == rows(want)
    index.update(docs)
    assert rows(index.postings()) == rows(sparse.postings(docs))
    assert {x["number"] for x in index.state()["segments"]} == {0, 1, 2} and index._live(index.state(), "forward", text_index.FORWARD).select("segment").distinct().count() == 1


def test_segments_without_numbers_are_searched(spark, tmp_path, monkeypatch):
    """Indexes of before have no numbers of documents, and don't say which segments their dead are of."""
    r = random.Random(6)
    texts = {f"d{i:03d}": t + " the" for i, t in enumerate(corpus(r, 60, 50))}
    docs = spark.createDataFrame(sorted(texts.items()), "hash string, content string")
    index = TextIndex(spark, f"file://{tmp_path}/i", buckets=2)
    index.update(docs)
    index.update(docs.where("hash < 'd020'"))
    q = spark.createDataFrame([(1, "w1 w2 the"), (2, texts["d030"])], "query_id int, text string")
    want = {(x.query_id, x.hash, x.score) for x in sparse.bm25(docs, q, 5).collect()}
    state = index.state()
    old = state | {"segments": [{k: v for k, v in x.items() if k != "numbered"} for x in state["segments"]], "dead": [{k: v for k, v in x.items() if k != "of"} for x in state["dead"]]}
    monkeypatch.setattr(index, "state", lambda version=None: old)
    assert {(x.query_id, x.hash, x.score) for x in index.search(q, 5).collect()} == want
    may = docs.where("hash like '%7'").select("hash")
    got = {(x.query_id, x.hash) for x in index.search(q, 5, keep=lambda df: df.join(may, "hash", "left_semi")).collect()}
    assert got == {(x.query_id, x.hash) for x in sparse.bm25(docs, q, 5, live=F.col("hash").like("%7")).collect()}
