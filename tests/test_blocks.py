"""BM25 in blocks against all pairs."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from memspark.operators import blocks, fusion, sparse


def _corpus(spark, n=300):
    words = [f"w{i}" for i in range(40)]
    text = lambda i: " ".join(words[(i * j * 7 + j) % 40] if j % 3 else words[i % 5] for j in range(i % 23))
    docs = [(f"h{i:04d}", text(i)) for i in range(n)]
    asked = [(i, text(i * 3 + 1)) for i in range(60)]
    return docs, asked, spark.createDataFrame(docs, "hash string, content string").repartition(5), spark.createDataFrame(asked, "query_id bigint, text string")


def _brute(docs, asked, k, may=lambda q, h: True):
    tf = {h: Counter(t.split()) for h, t in docs}
    mean, n = sum(sum(c.values()) for c in tf.values()) / len(docs), len(docs)
    df = Counter(t for c in tf.values() for t in c)
    out = {}
    for q, text in asked:
        got = []
        for h, c in tf.items():
            part = [max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in dict.fromkeys(text.split()) if t in c]
            if part and may(q, h):
                got.append((-round(sum(part), 9), h))
        out |= {(q, h): round(-s, 6) for s, h in sorted(got)[:k]}
    return out


def test_blocks_find_what_all_pairs_give(spark, monkeypatch):
    docs, asked, d, q = _corpus(spark)
    want = _brute(docs, asked, 7)
    for dense in (0.0, 0.04, 2.0):
        for name, v in {"DOCS": 16, "ENTRIES": 90, "QUERIES": 25, "CHUNK": 8, "DENSE": dense}.items():
            monkeypatch.setattr(blocks, name, v)
        assert {(r.query_id, r.hash): round(r.score, 6) for r in sparse.bm25(d, q, 7).collect()} == want
    both = [sparse.bm25(d, q, 7, index=i) for i in (sparse.postings(d), sparse.forward(d))]
    assert all({(r.query_id, r.hash): round(r.score, 6) for r in x.collect()} == want for x in both)
    assert {(r.query_id, r.hash) for r in sparse.bm25(d, q, 7, keep=lambda x: x).select("query_id", "hash").collect()} == set(want)


def test_only_the_best_of_a_task_are_shuffled(spark):
    docs, asked, d, q = _corpus(spark)
    rows, terms = sparse.forward(d), sparse.query_terms(q)
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = sparse.scored_blocks(rows, terms, df, len(docs), 11.0, 1.2, 0.75, 3).count()
    assert n <= 3 * 60 * spark.sparkContext.defaultParallelism < sparse.scored_blocks(rows, terms, df, len(docs), 11.0, 1.2, 0.75, None).count()


def test_windows_of_queries_are_masks(spark):
    docs, asked, d, q = _corpus(spark)
    among = spark.createDataFrame([(h, f"s{i % 2}", float(i), float(i + 5)) for i, (h, _) in enumerate(docs) if i % 10], "hash string, _source string, start double, end double")
    limited = q.withColumns({"lower": F.when(F.col("query_id") % 2 == 0, F.lit(100.0)), "upper": F.when(F.col("query_id") % 3 == 0, F.lit(200.0)), "source": F.when(F.col("query_id") % 5 == 0, "s1")})
    at = {h: i for i, (h, _) in enumerate(docs)}
    may = lambda q, h: at[h] % 10 and (q % 2 or at[h] + 5 >= 100) and (q % 3 or at[h] <= 200) and (q % 5 or at[h] % 2 == 1)
    got = {(r.query_id, r.hash): round(r.score, 6) for r in sparse.bm25(d, limited, 5, among=among).collect()}
    assert got == _brute(docs, asked, 5, may)


def _shuffled(spark) -> int:
    """Rows written to shuffles by the application so far."""
    jvm, sc = spark._jvm, spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_ngrams_meet_in_blocks(spark):
    """F8: n-gram recall shuffles what tasks find best, not documents times n-grams; ties, short texts and windows as pair by pair."""
    r = random.Random(8)
    texts = ["".join(r.choice("abcd \n") for _ in range(r.choice((0, 1, 2, 40, 60)))) for _ in range(400)]
    docs = spark.createDataFrame([(f"h{i:03d}", t, "s%d" % (i % 2), float(i), float(i)) for i, t in enumerate(texts)], "hash string, content string, _source string, start double, end double").repartition(4)
    asked = [(0, "abcabc", None, None, None), (1, "a", None, None, None), (2, "bd ca", 100.0, 150.0, None), (3, "zz", None, None, None), (4, "dddd", None, None, "s1"), (5, " ", None, None, None)]
    q = spark.createDataFrame(asked, "query_id int, text string, lower double, upper double, source string")
    squeeze = lambda t: "".join(t.split()).lower()
    grams = lambda t: {t[i : i + 2] for i in range(max(1, len(t) - 1))} if t else set()

    def want(limited: bool, k: int):
        out = set()
        for n, t, lower, upper, source in asked:
            g = grams(squeeze(t))
            see = [i for i in range(400) if not limited or ((lower is None or lower <= i <= upper) and (source is None or source == f"s{i % 2}"))]
            found = sorted((-len(g & grams(squeeze(texts[i]))) / len(g), f"h{i:03d}") for i in see if g & grams(squeeze(texts[i])))[:k]
            out |= {(n, h, -s) for s, h in found}
        return out

    seen = _shuffled(spark)
    got = {(x.query_id, x.hash, x.score) for x in sparse.ngram_search(docs, q, 7).collect()}
    assert got == want(False, 7) and _shuffled(spark) - seen < 1000
    spans = docs.select("hash", "_source", "start", "end")
    assert {(x.query_id, x.hash, x.score) for x in sparse.ngram_search(docs, q, 7, among=spans).collect()} == want(True, 7)
    even = sparse.ngram_search(docs, q, 7, keep=lambda hits: hits.where("hash like '%5'")).collect()
    assert {(x.query_id, x.hash, x.score) for x in even} == {x for x in want(False, 400) if x[1].endswith("5")} & {(x.query_id, x.hash, x.score) for x in even} and even


def test_entity_scores_meet_only_a_querys_results(spark):
    """F2: scores of an entity are not paired with all paragraphs of the entity."""
    n = 300
    results = spark.range(n).selectExpr("id as query_id", "concat('p', id) as hash", "0.5D as score")
    bridge = spark.range(n).selectExpr("concat('p', id) as paragraph_hash", "'e' as entity_hash").unionByName(spark.createDataFrame([("p7", "f")], "paragraph_hash string, entity_hash string"))
    ppr = spark.range(0, n, 2).selectExpr("id as query_id", "'e' as entity_hash", "1.0D as ppr").unionByName(spark.createDataFrame([(7, "f", 0.25)], "query_id bigint, entity_hash string, ppr double"))
    seen = _shuffled(spark)
    got = {(x.query_id, x.hash): round(x.score, 6) for x in fusion.ppr_rerank(results, bridge, ppr).collect()}
    assert _shuffled(spark) - seen < 10 * n
    assert got == {(i, f"p{i}"): 0.65 if i % 2 == 0 else 0.425 if i == 7 else 0.5 for i in range(n)}


def test_names_are_compared_among_ties_only():
    """Merging a task's best sorts numbers; names decide between equal scores."""
    seen = []

    class Name(str):
        def __lt__(self, other):
            seen.append(1)
            return str.__lt__(self, other)

    r = random.Random(9)
    q, score = np.array([r.randrange(50) for _ in range(4000)]), np.array([r.random() for _ in range(3998)] + [2.0, 2.0])
    q[-2:] = 7
    name = np.array([Name(f"n{i:05d}") for i in r.sample(range(4000), 4000)], object)
    want = sorted(zip(q.tolist(), (-score).tolist(), map(str, name)))
    seen.clear()
    got = list(zip(*(x.tolist() for x in blocks._first(q, score, name, 5))))
    assert len(seen) < 10
    assert got == [(a, -b, c) for i, (a, b, c) in enumerate(want) if i < 5 or want[i - 5][0] != a]


def test_words_go_as_one_text(spark):
    """The same forward rows as of arrays of words, without such arrays."""
    texts = ["", None, "  Tea,tea_1 -- ÉTÉ été\n东 京 x", "...", "a" * 3000 + " b"]
    d = spark.createDataFrame([(f"h{i}", t) for i, t in enumerate(texts)], "hash string, content string")
    rows = sparse.forward(d)
    assert "split(" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.hash, t, n, r.dl) for r in rows.collect() for t, n in zip(r.terms, r.tfs)}
    assert got == {(r.hash, r.term, r.tf, r.dl) for r in sparse.postings(d).collect()} and rows.count() == 5
