"""Queries with windows, sources and persons of their own."""

import random

import numpy as np
import pytest
from memspark.operators import intervals, knn
from memspark.plans.engine import Engine
from memspark.plans.fixtures import NOW, T0, Fixtures
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlap_join(spark, seed):
    """Open bounds, long and empty intervals, ends before starts, no time, windows outside: each pair once."""
    r = random.Random(seed)
    span = lambda: (a := r.uniform(0, 1000), a + r.choice((0, 1, 5, 5, 300, 900, -3)))
    items = [(i, *span()) for i in range(200)] + [(900, None, 3.0), (901, None, None), (902, 0.0, 1e6)]
    windows = [(i, *(x if r.random() > 0.2 else None for x in span())) for i in range(60)] + [(70, -50.0, -40.0), (71, 2e6, None), (72, None, -1.0), (73, None, None), (74, 500.0, 500.0)]
    got = intervals.overlap_join(spark.createDataFrame(windows, "query_id int, lower double, upper double"), spark.createDataFrame(items, "id int, start double, end double")).select("query_id", "id").collect()
    want = {(q, i) for q, lo, hi in windows if lo is not None or hi is not None for i, a, z in items if a is not None and z is not None and (lo is None or z >= lo) and (hi is None or a <= hi)}
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert intervals.overlap_join(spark.createDataFrame(windows, "query_id int, lower double, upper double"), spark.createDataFrame(items[:0], "id int, start double, end double")).count() == 0


def test_dense_within(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 8))
    names = [f"h{i:03d}" for i in range(300)]
    p = spark.createDataFrame([(h, "s%d" % (i % 3) if i % 7 else None, float(i)) for i, h in enumerate(names)], "hash string, source string, created_at double").selectExpr("*", *[f"cast(null as double) {c}" for c in ("event_time", "event_time_start", "event_time_end")])
    v = spark.createDataFrame([(h, [float(z) for z in y]) for h, y in zip(names, x, strict=True)], "hash string, embedding array<float>")
    q = [(0, None, None, None, None), (1, 50.0, 90.0, None, None), (2, None, 30.0, "s1", None), (3, 250.0, None, "s2", None), (4, 400.0, None, None, None), (5, 20.0, 200.0, None, "Ann")]
    queries = spark.createDataFrame([(*row, [float(z) for z in x[40 * row[0]] + 0.1]) for row in q], "query_id int, lower double, upper double, source string, person string, embedding array<float>")
    allowed = spark.createDataFrame([(5, h) for h in names[::4]], "query_id int, hash string")
    got = knn.search_within(v, queries, p, 6, allowed).collect()
    want = set()
    for row in q:
        y = x[40 * row[0]] + 0.1
        ok = [i for i in range(300) if (row[1] is None or i >= row[1]) and (row[2] is None or i <= row[2]) and (row[3] is None or (i % 7 and f"s{i % 3}" == row[3])) and (row[4] is None or i % 4 == 0)]
        best = sorted(ok, key=lambda i: -(x[i].astype(np.float32) @ y.astype(np.float32)) / np.linalg.norm(x[i]))[:6]
        want |= {(row[0], names[i]) for i in best}
    assert {(t.query_id, t.hash) for t in got} == want and not any(t.query_id == 4 for t in got)


def test_a_batch_answers_as_each_alone(spark):
    """One plan for requests with different windows, sources and persons."""
    x = Fixtures(spark, SF)
    e = Engine(x.store | {"paragraph_index": x.posting, "relation_index": x.relation_posting})
    texts = x.para.where("doc_id in (3, 8)").orderBy("doc_id").select("content").collect()
    emb = x.table("embeddings").where("vec_id < 4").orderBy("vec_id").collect()
    limits = [(None, None, None, None), (T0 + 36000.0, T0 + 360000.0, None, None), (None, T0 + 500000.0, "src1", None), (T0 + 1.0, NOW, None, "#00000001")]
    words = [" ".join(t.content.split()[:6]) for t in texts] * 2
    rows = [(i, w, [float(z) for z in v.embedding], *lim) for i, (w, v, lim) in enumerate(zip(words, emb, limits, strict=True))]
    batch = spark.createDataFrame(rows, "query_id int, text string, embedding array<float>, lower double, upper double, source string, person string")
    together = {}
    for t in e.search(batch, paths_on=False).collect():
        together.setdefault(t.query_id, []).append((t["rank"], t.hash, round(t.score, 9)))
    newest = {}
    for t in e.in_time(batch, k=7).collect():
        newest.setdefault(t.query_id, []).append((t["rank"], t.hash))
    for i, lim in enumerate(limits):
        given = dict(zip(("lower", "upper", "source", "person"), lim, strict=True))
        one = batch.where(f"query_id = {i}").select("query_id", "text", "embedding")
        alone = sorted((t["rank"], t.hash, round(t.score, 9)) for t in e.search(one, paths_on=False, **given).collect())
        assert alone == sorted(together.get(i, []))
        assert sorted((t["rank"], t.hash) for t in e.in_time(one, k=7, **given).collect()) == sorted(newest.get(i, []))
    assert len(together) >= 2 and len(newest) >= 3


@pytest.mark.parametrize("seed", [1, 2])
def test_newest_of_windows(spark, seed):
    """Open and crossed bounds, sources, ties, long intervals, ends before starts, no time: the k newest of all pairs."""
    r = random.Random(seed)
    span = lambda: (float(a := r.randint(0, 300)), float(a + r.choice((0, 1, 5, 90, -3))))
    items = [(f"h{i:03d}", *span(), r.choice((1.0, 2.0, None)), r.choice(("a", "b", "", None))) for i in range(250)] + [("x", None, 3.0, 1.0, "a"), ("y", None, None, 1.0, "a")]
    windows = [(i, *(x if r.random() > 0.3 else None for x in span()), r.choice((None, None, "a", "b", "", "c"))) for i in range(80)] + [(90, 400.0, None, None), (91, None, -1.0, None), (92, None, None, "a"), (93, 250.0, 50.0, None)]
    w = spark.createDataFrame(windows, "query_id int, lower double, upper double, source string")
    p = spark.createDataFrame(items, "hash string, start double, end double, updated_at double, _source string")
    got = {}
    for x in intervals.newest(w, p, 4).collect():
        got.setdefault(x.query_id, []).append(x.hash)
    for q, lo, hi, s in windows:
        ok = [i for i in items if i[1] is not None and i[2] is not None and (lo is None or i[2] >= lo) and (hi is None or i[1] <= hi) and (s is None or s == i[4])]
        ok = sorted(ok, key=lambda i: (-i[2], -(i[3] or 0.0), i[0]))[:4] if lo is not None or hi is not None else []
        assert sorted(i[0] for i in ok) == sorted(got.get(q, []))


def test_newest_does_not_pair_windows_with_all_they_hold(spark, monkeypatch):
    """Half-open windows hold half of the paragraphs each; what is joined grows with both tables' rows."""
    join, pairs = intervals.overlap_join, []

    def counted(windows, items):
        found = join(windows, items)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(intervals, "overlap_join", counted)
    p = spark.range(2000).selectExpr("concat('h', id) hash", "'t' content", "cast(null as string) source", "double(id) created_at", "double(id) updated_at", "false is_deleted", *[f"cast(null as double) {c}" for c in ("event_time", "event_time_start", "event_time_end")])
    w = spark.range(400).selectExpr("id query_id", "cast(null as double) lower", "double(id * 5) upper")
    got = Engine({"paragraph": p}).in_time(w, k=3).collect()
    assert {(x.query_id, x.hash, x["rank"]) for x in got} == {(i, f"h{5 * i - n}", n + 1) for i in range(400) for n in range(3) if 5 * i - n >= 0}
    assert sum(pairs) <= 2 * 2400
