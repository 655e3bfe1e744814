"""Exact, line, substring and near dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from memspark.llm.common import input_bytes, mix64, shards_for
from memspark.llm.exact_dedup import exact_dedup
from memspark.llm.line_dedup import line_dedup
from memspark.llm.near_dedup import drop_near_copies, near_dedup
from memspark.llm.substring_dedup import substring_dedup
from pyspark.sql import functions as F

from . import helpers as h


def known(df):
    """(doc_id, text) of rows with an id, each id once."""
    return sorted({(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None})


def test_exact(spark):
    docs = h.edge_docs(spark)
    got = exact_dedup(docs).collect()
    assert len(got) == docs.count()
    many = {}
    for r in docs.collect():
        many.setdefault(h.brute_exact([(0, r.text)])[0][2], []).append(r.doc_id)
    for r in got:
        ids = many[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    for digest in many:
        assert sum(r.kept for r in got if r.text_sha256 == digest) == 1


def test_exact_in_many_batches(spark):
    docs = spark.createDataFrame([(i, f"t{i % 17}") for i in range(300)], "doc_id long, text string").repartition(9)
    got = {r.doc_id: r for r in exact_dedup(docs, bytes_per_batch=500).collect()}
    for i, (keep, n, digest) in h.brute_exact([(i, f"t{i % 17}") for i in range(300)]).items():
        assert (got[i].keep_id, got[i].group_size, got[i].text_sha256, got[i].kept) == (keep, n, digest, keep == i)


def test_lines(spark):
    docs = h.edge_docs(spark)
    out = line_dedup(docs)
    assert set(out.columns) == set(docs.columns) | {"n_dropped"} and dict(out.dtypes)["n_lines"] == "bigint"
    got = {r.doc_id: r for r in out.collect()}
    for i, want in h.brute_lines(known(docs)).items():
        assert (got[i].n_lines, got[i].n_dropped, h.sha(got[i].text)) == want
    assert got[None].text == "a text without an id, longer than ten" and got[None].source == "hot"


def test_hot_line(spark):
    docs = spark.createDataFrame([(i, f"only here {i:09d}\nthe very common line\nthe very common line") for i in range(500)], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert got[0].n_dropped == 0 and all(got[i].n_dropped == 2 for i in range(1, 500))


def test_substrings(spark):
    docs = h.edge_docs(spark)
    got = {r.doc_id: r for r in substring_dedup(docs).collect()}
    data = [(-1 if r.doc_id is None else r.doc_id, r.text) for r in docs.dropDuplicates(["doc_id"]).collect()]
    for i, want in h.brute_substrings(data).items():
        r = got[None if i == -1 else i]
        assert (r.n_bytes, r.n_removed, r.n_spans, h.sha(bytes(r.kept))) == want
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


@pytest.mark.parametrize("sent", [32 << 20, -1])
def test_line_index_answers_for_other_documents(spark, monkeypatch, sent):
    """The written index alone tells unseen documents their lines, sent to all tasks or probed shard by shard; and lines that share 64 bits stay apart."""
    import memspark.llm.line_dedup as m

    monkeypatch.setattr(m, "SENT", sent)
    docs = h.edge_docs(spark)
    data = [(-1 if r.doc_id is None else r.doc_id, r.text) for r in docs.dropDuplicates(["doc_id"]).collect()]
    got = {r.doc_id: (r.n_lines, r.n_dropped, h.sha(r.text)) for r in line_dedup(docs).collect()}
    assert {i: got[None if i == -1 else i] for i in dict(data)} == h.brute_lines(data)
    index = m.index_lines(spark.createDataFrame([(1, "a shared line\nonly here, once"), (5, "A SHARED LINE \nanother one"), (6, "another one\nshort\nshort"), (7, "short")], "doc_id long, text string"))
    new = spark.createDataFrame([(0, "a shared line\nonly here, once"), (9, "x\n a shared line\nanother one\nshort"), (5, "another one")], "doc_id long, text string")
    left = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in m.drop_lines(new, index).collect()}
    assert left == {0: ("only here, once", 2, 1), 9: ("x\nshort", 4, 2), 5: ("another one", 1, 0)}
    assert m.drop_lines(new.limit(0), index).count() == 0 and m.index_lines(new.limit(0)).table.count() == 0


def test_line_shard():
    """A shard's arrays against a dictionary, with keys that share their first 64 bits."""
    import memspark.llm.line_dedup as m

    r = np.random.default_rng(3)
    e = np.zeros(5000, m.ENTRY)
    e["hi"] = r.integers(0, 900, 5000)
    e["lo"] = mix64(2 * e["hi"] + r.integers(0, 2, 5000).astype(np.uint64))
    e["first"] = r.integers(0, 50, 5000)
    e["last"] = e["first"] + r.integers(0, 2, 5000)
    shard = m.Shard.read(m.build_shard([e[:2000].tobytes(), e[2000:].tobytes()]))
    low, high = {}, {}
    for x in e:
        k = (int(x["hi"]), int(x["lo"]))
        low[k], high[k] = min(low.get(k, 99), int(x["first"])), max(high.get(k, -1), int(x["last"]))
    want = [m.KEEP if low[k] == high[k] else m.ONLY_FIRST if low[k] == f else m.NOWHERE for k, f in (((int(x["hi"]), int(x["lo"])), int(x["first"])) for x in e)]
    assert shard.states(e).tolist() == want and len(shard.odd) > 10
    other = e[:50].copy()
    other["hi"] += 10_000
    assert not shard.states(other).any()


@pytest.mark.parametrize("words", [4, 5])
def test_near(spark, words):
    docs = h.edge_docs(spark)
    got = {r.doc_id: r for r in near_dedup(docs, words=words).collect()}
    assert near_dedup(docs, words=words).count() == docs.count()
    for i, want in h.brute_near(known(docs), words).items():
        assert (got[i].n_shingles, got[i].component_id) == want
    assert got[None].component_id is None and got[None].kept
    kept = Counter((r.component_id, r.doc_id, r.n_shingles > 0) for r in near_dedup(docs, words=words).where("kept").collect())
    assert all(c == i for c, i, _ in kept) and all(n == 1 for (c, i, some), n in kept.items() if some)
    assert {c for c, _, _ in kept} == {r.component_id for r in got.values()}


def test_near_rows_with_shared_ids(spark):
    """Rows are documents: an id that two texts share is no link, and of each group one row stays."""
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(3, a, "x"), (5, a, "y"), (5, b, "z"), (7, b, "w"), (None, a.upper(), "n"), (None, a, "m"), (9, None, "e"), (9, " ", "f")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, body string").repartition(3)
    got = Counter(tuple(r) for r in near_dedup(docs).collect())
    n = len(h.shingles(a, 5))
    assert sum(got.values()) == 8 and sum(v for k, v in got.items() if k[3]) == 4
    assert {k[:3] for k in got} == {(3, n, None), (5, n, None), (5, n, 5), (7, n, 5), (None, n, None), (9, 0, 9)}
    left = drop_near_copies(docs)
    assert left.schema == docs.schema
    texts = sorted((r.text or "").lower() for r in left.collect())
    assert texts == sorted([a, b, "", " "])
    no_ids = spark.createDataFrame([(None, t) for t in (a, a, b, b + " tail")], "doc_id long, text string")
    assert sorted(t.text[0] for t in drop_near_copies(no_ids).collect()) == ["a", "b"]
    assert drop_near_copies(docs.limit(0)).count() == 0


def test_input_bytes(spark, tmp_path):
    """Files are told by their size, and what can't be told is measured."""
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(500)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/d")
    files = spark.read.parquet(f"{tmp_path}/d")
    assert 0 < input_bytes(files) < 200_000 and input_bytes(files.select("text").where("doc_id > 3")) > 0
    many = files.crossJoin(spark.range(3)).crossJoin(spark.range(2).withColumnRenamed("id", "id2"))
    assert input_bytes(many) == 500 * 6 * 1008
    assert input_bytes(docs.mapInArrow(lambda it: it, docs.schema)) == 500 * 1008
    assert input_bytes(docs.limit(0)) == 0 and shards_for(many, 1 << 20) == 4


@pytest.mark.parametrize("by_sets, by_shingles", [(3, 10**9), (10**9, 400)])
def test_near_in_blocks(spark, monkeypatch, by_sets, by_shingles):
    """Components too large for a task are compared block by block, with the same result."""
    import memspark.llm.near_dedup as m

    monkeypatch.setattr(m, "BLOCK", by_sets)
    monkeypatch.setattr(m, "BLOCK_SHINGLES", by_shingles)
    monkeypatch.setattr(m, "STEP", 50)
    docs = spark.read.parquet(f"{h.SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(docs, words=4).collect()}
    assert got == h.brute_near([tuple(r) for r in docs.collect()], 4)


def test_exact_with_colliding_digests(spark, monkeypatch):
    """Over a thousand digests that each stand for two texts: these are told apart by their bytes."""
    import memspark.llm.exact_dedup as m

    monkeypatch.setattr(m, "digest", lambda c: F.unhex(F.sha2(F.substring_index(c, "/", 1), 256)))
    rows = [(3 * i + k, f"text {i}/{k % 2}") for i in range(1200) for k in range(3)]
    got = {r.doc_id: r for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(1200):
        a, b, c = (got[3 * i + k] for k in range(3))
        assert (a.keep_id, a.group_size, a.kept) == (3 * i + 2, 2, False) and c.kept and (b.keep_id, b.group_size, b.kept) == (3 * i + 1, 1, True)


def test_near_from_late_partitions(spark, monkeypatch):
    """Set numbers of input partitions up to the last that the layout allows."""
    import memspark.llm.near_dedup as m

    first = m.group_seed
    docs = spark.read.parquet(f"{h.SF}/documents.parquet").select("doc_id", "text").repartition(5)
    want = h.brute_near([tuple(r) for r in docs.collect()], 5)
    shift = (1 << m.CHUNK_BITS) - 6
    monkeypatch.setattr(m, "group_seed", lambda: first() + (shift << 32))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(docs).collect()} == want


def test_near_recall(spark):
    """Links of pairs just above the threshold, which no third document helps to find."""
    r = random.Random(8)
    rows = []
    for i in range(400):
        words = [f"w{r.randrange(10**7)}" for _ in range(r.randint(60, 200))]
        at = r.sample(range(6, len(words) - 6), max(1, len(words) // 46))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join("x" + w if k in at else w for k, w in enumerate(words)))]
    want = {i: c for i, (_, c) in h.brute_near(rows, 5).items()}
    linked = [i for i in want if want[i] != i]
    got = {x.doc_id: x.component_id for x in near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(linked) > 200 and sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked)
    assert all(got[i] in (i, want[i]) for i in want)


@pytest.mark.parametrize("op", [exact_dedup, line_dedup, substring_dedup, near_dedup])
def test_empty(spark, op):
    assert op(h.empty_docs(spark)).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert op(one).count() == 1


def test_dedup_queries_on_files(spark):
    """The registered queries over whole tables."""
    from memspark.llm.queries import queries

    docs = spark.read.parquet(f"{h.SF}/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    q = queries()
    rows = lambda name, *cols: {r.doc_id: tuple(r[c] for c in cols) for r in q[name](spark, h.SF).collect()}
    assert rows("op2_substring_dedup", "n_bytes", "n_removed", "n_spans", "kept_sha256") == h.brute_substrings(data)
    assert rows("op10_near_dedup", "n_shingles", "component_id") == h.brute_near(data, 4)
    assert rows("op8_line_dedup", "n_lines", "n_dropped", "kept_sha256") == h.brute_lines(data)
    assert rows("op5_exact_dedup", "keep_id", "group_size", "text_sha256") == h.brute_exact(data)
    assert docs.agg(F.count("*")).first()[0] == len(data)
