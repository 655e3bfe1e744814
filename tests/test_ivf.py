"""Exact blocks and the inverted-file index against brute force."""

import numpy as np
import pytest
from memspark.operators import ivf, knn, matrix
from memspark.plans.fixtures import Fixtures
from memspark.plans.queries import QUERIES
from pyspark.sql import functions as F

V = "hash string, item_type string, embedding array<float>"


def clustered(n=6000, dim=32, groups=60, seed=1):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(groups, dim))
    return (centers[r.integers(groups, size=n)] + 0.35 * r.normal(size=(n, dim))).astype(np.float32)


def frame(spark, x, kind=lambda i: "paragraph"):
    rows = [(f"h{i:06d}", kind(i), [float(z) for z in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, V).repartition(5)


def brute(x, q, k, among=None):
    u, w = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x.astype(float), q.astype(float)))
    s = w @ u.T
    if among is not None:
        s[:, ~among] = -9
    return [[f"h{j:06d}" for j in np.lexsort((np.arange(len(x)), -row))[:k]] for row in s]


def asked(spark, q):
    return spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(q)], "query_id int, embedding array<float>")


def recall(found, want, k):
    by = {}
    for r in found:
        by.setdefault(r.query_id, set()).add(r.hash)
    return sum(len(by.get(i, set()) & set(w)) for i, w in enumerate(want)) / (k * len(want))


def test_index_reads_little_of_clustered_vectors(spark):
    """At least 0.9 of the ten nearest, from at most 15 % of the rows."""
    x = clustered()
    q = clustered(seed=1)[::100] + 0.05
    index = ivf.build(frame(spark, x), 32)
    got = ivf.search(index, asked(spark, q), 10).collect()
    assert recall(got, brute(x, q, 10), 10) >= 0.9
    sizes = {int(r.cell): r["count"] for r in index.vectors.groupBy("cell").count().collect()}
    read = ivf.probe(index, asked(spark, q)).groupBy("query_id").agg(F.collect_list("cell").alias("c")).collect()
    assert np.mean([sum(sizes.get(c, 0) for c in r.c) for r in read]) <= 0.15 * len(x)
    assert sum(sizes.values()) == len(x) == index.lists.select(F.sum(F.size("ids"))).first()[0]
    exact = {(r.query_id, r.hash): r.score for r in knn.search(frame(spark, x), asked(spark, q), 10).collect()}
    assert all(abs(exact[r.query_id, r.hash] - r.score) < 1e-6 for r in got if (r.query_id, r.hash) in exact)
    one = ivf.search(index, asked(spark, q[:1]), 10, probes=2)
    assert len({f.rsplit("cell=")[1].split("/")[0] for f in index.lists.where(F.col("cell").isin([r.cell for r in ivf.probe(index, asked(spark, q[:1]), 2).collect()])).inputFiles()}) >= 1 and one.count() == 10
    again = ivf.load(spark, index.path)
    assert sorted(map(tuple, ivf.search(again, asked(spark, q), 10).collect())) == sorted(map(tuple, got))


def test_index_query_recall(spark):
    """The registered query over the whole 64-dimensional table, whose vectors have no clusters."""
    sf = "/root/testdata/sf0.1"
    x = Fixtures(spark, sf)
    near = {(r.query_id, r.hash) for r in knn.search(x.vector, x.queries, 10).collect()}
    got = {(r.query_id, r.hash) for r in QUERIES["knn_ivf"](spark, sf).collect()}
    print("recall", len(near & got) / len(near), "probes", x.ivf.probes, len(x.ivf.centroids))
    assert len(near) == 200 and len(near & got) >= 0.9 * len(near)


def test_index_of_odd_rows(spark):
    """Null, empty, infinite and zero vectors, other lengths, equal vectors, item types, one hot cell."""
    x = np.concatenate([np.tile(clustered(1, 8), (300, 1)), clustered(200, 8, 5)])
    kind = lambda i: "relation" if i % 3 else "paragraph"
    odd = [("n", "x", None), ("e", "x", []), ("i", "x", [float("inf")] * 8), ("s", "x", [1.0] * 7), (None, "x", [None] * 8), ("z", None, [0.0] * 8)]
    rows = frame(spark, x, kind).unionByName(spark.createDataFrame(odd, V))
    index = ivf.build(rows, 8, cells=6)
    assert index.vectors.count() == 501
    q = x[::50]
    got = ivf.search(index, asked(spark, q), 5, probes=6, item_type="relation", rescore=100).collect()
    want = brute(x, q, 5, np.array([bool(i % 3) for i in range(len(x))]))
    assert {(r.query_id, r.hash) for r in got} == {(i, h) for i, w in enumerate(want) for h in w}
    assert ivf.search(index, spark.createDataFrame([(1, None), (2, [1.0])], "query_id int, embedding array<float>")).count() == 0
    empty = ivf.build(rows.limit(0), 8)
    assert ivf.search(empty, asked(spark, q)).count() == 0


@pytest.mark.parametrize("sent", [matrix.SENT, 1])
def test_exact_search_in_blocks(spark, monkeypatch, sent):
    """Blocks sent to all tasks, or dealt to a grid: the same rows."""
    monkeypatch.setattr(matrix, "SENT", sent)
    monkeypatch.setattr(matrix, "ROWS", 64)
    x = np.concatenate([clustered(700, 16, 9), np.tile(clustered(1, 16, 1, 3), (50, 1))])
    q = x[::7]
    got = knn.search(frame(spark, x), asked(spark, q), 12).collect()
    assert {(r.query_id, r.hash, r["rank"]) for r in got} == {(i, h, n + 1) for i, w in enumerate(brute(x, q, 12)) for n, h in enumerate(w)}


@pytest.mark.parametrize("threshold", [0.8, 0.95])
def test_synonyms_are_whole(spark, threshold):
    x = np.concatenate([clustered(500, 12, 20), clustered(40, 12, 20)])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = (u[:, None, :] * u[None]).sum(axis=2)
    want = {(f"h{i:06d}", f"h{j:06d}") for i, j in zip(*np.nonzero((s >= threshold) & (s < 1 - 1e-12)), strict=True) if i < j}
    got = [(r.src, r.dst) for r in ivf.synonyms(frame(spark, x), threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_synonyms_move_rows_once(spark):
    """what is shuffled and written grows with rows, not with rows times the cells that they may look into."""
    def moved() -> int:
        jvm, sc = spark._jvm, spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size()))

    x = np.random.default_rng(3).normal(size=(5000, 16)).astype(np.float32)
    index = ivf.build(frame(spark, x), 16, asked=0)
    before = moved()
    got = {(r.src, r.dst) for r in ivf.similar(index, 0.8).collect()}
    assert moved() - before < 6 * x.size * 8
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.8, 1))
    assert got == {(f"h{i:06d}", f"h{j:06d}") for i, j in zip(a, b, strict=True)} and got
