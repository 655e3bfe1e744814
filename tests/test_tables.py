"""The store's tables: made when asked for, and what making them shuffles."""

import os

from pyspark.sql import functions as F

from memspark.functions import text as tx
from memspark.operators import evaluate, lifecycle
from memspark.plans import queries, store_queries  # noqa: F401
from memspark.plans.fixtures import NOW, Fixtures, Tables
from memspark.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def _own(tmp_path):
    """A folder of its own with the same files, so that nothing of it is written yet."""
    for f in os.listdir(DATA):
        os.symlink(f"{DATA}/{f}", f"{tmp_path}/{f}")
    return str(tmp_path)


def _written(folder):
    return {k[2] for k in Fixtures._written if k[1] == folder}


def test_tables_are_made_when_asked_for():
    made = []
    t = Tables({"a": lambda: made.append("a") or 1, "b": lambda: made.append("b") or 2}) | {"c": 3}
    assert set(t) == {"a", "b", "c"} and t["c"] == 3 and not made
    assert t["a"] == 1 and t["a"] == 1 and made == ["a"] and t.get("none") is None
    assert dict({"b": 5} | t)["b"] == 2


def test_a_query_writes_the_tables_that_it_reads(spark, tmp_path):
    folder = _own(tmp_path)
    QUERIES["engine_time"](spark, folder).collect()
    assert _written(folder) == {"paragraph"}
    QUERIES["engine_relation_exact"](spark, folder).collect()
    assert _written(folder) == {"paragraph", "relation"}


def test_texts_of_paragraphs_are_not_grouped_or_joined_by_a_shuffle(spark, tmp_path):
    x = Fixtures(spark, _own(tmp_path))
    plan = x._para()._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "SortMergeJoin" not in plan


def test_normalize_passes_over_single_spaces_only(spark):
    raw = ["a b", "a  b", "a \tb", "a\t", "é é", "é  é", " é　x  y", "a\r\nb \r c", "a \n b", "\x1cz\x85 z", None]
    want = ["a b", "a b", "a b", "a", "é é", "é é", "é x y", "a\nb \n c", "a \n b", "z z", ""]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, t string").select("i", tx.normalize(F.col("t")).alias("t"), tx.word_count(F.col("t")).alias("n"), tx.words(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r.t for r in got] == want
    assert [r.n for r in got] == [len((r or "").split()) for r in raw] and got[5].w == ["é", "é"]


def test_sampled_triples_rank_no_more_than_the_sample(spark):
    rows = [(f"{p}{i:03d}", f"s{i}", p, f"o{i % 3}") for p, n in (("buys", 300), ("part_of", 2), ("in", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "hash string, subject string, predicate string, object string")
    found = evaluate.sample_triples(df, 12)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert len(got) == 12 and {r.predicate: sum(x.predicate == r.predicate for x in got) for r in got} == {"buys": 5, "in": 5, "part_of": 2}


def test_ppr_bridge_has_one_link_a_paragraph(spark, monkeypatch):
    from memspark.operators import fusion

    seen = {}
    monkeypatch.setattr(fusion, "ppr_rerank", lambda results, bridge, ppr, weight=0.3: seen.update(bridge=bridge, ppr=ppr) or results)
    QUERIES["fuse_ppr"](spark, DATA)
    n, per = seen["bridge"].count(), seen["bridge"].select("paragraph_hash").distinct().count()
    assert n == per > 0


def test_restore_and_prune_leave_edges_alone(spark):
    """Who asks for relations pays for relations: edges are neither read nor made before they are asked for."""
    x = Fixtures(spark, "/root/testdata/sf0.001")
    asked = []

    def edge():
        asked.append("edge")
        return x.edge

    store = x.store | {"edge": edge}
    restored, pruned = lifecycle.restore_memory(store, x.deleted_relation), lifecycle.prune(store, NOW)
    assert restored["relation"].count() == x.relation.count() + x.deleted_relation.where("hash like 'x%'").count()
    assert restored["relation"].where("is_inactive").join(x.deleted_relation, "hash", "left_semi").count() == 0 and not asked
    assert pruned["relation"].count() < x.relation.count() and not asked
    assert restored["edge"].count() == x.edge.count() and asked


def test_only_pairs_with_several_relations_are_grouped(spark):
    x = Fixtures(spark, DATA)
    rows = [(f"{i:064x}", f"S{i % 40}", ("buys", "Likes")[i // 40], f"O{i % 40 if i < 45 else i}", i / 100) for i in range(80)]
    x.__dict__["relation"] = spark.createDataFrame(rows, "hash string, subject string, predicate string, object string, confidence double")
    edges = x._edge()
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "LeftAnti" in plan  # single relations pass by the grouping
    want = {}
    for h, s, _, o, c in rows:
        w, hs = want.get((s.lower(), o.lower()), (0.0, []))
        want[s.lower(), o.lower()] = (w + c, sorted([*hs, h]))
    got = {(r.src, r.dst): (r.weight, r.relation_hashes) for r in edges.collect()}
    assert got.keys() == want.keys() and len(want) == 75 and edges.count() == 75
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-12 for k in want)


def test_what_a_deletion_takes_is_found_once(spark):
    """tables after delete_source read themselves and what goes, not paragraphs and links again; a pair stays that keeps a relation."""
    from memspark.operators import dml

    store = {
        "paragraph": spark.createDataFrame([("p1", "a"), ("p2", "a"), ("p3", "b")], "hash string, source string"),
        "relation": spark.createDataFrame([("r1", "X", "is", "Y"), ("r2", "x", "has", "y"), ("r3", "X", "is", "Z"), ("r4", "Q", "is", "Z")], "hash string, subject string, predicate string, object string"),
        "edge": spark.createDataFrame([("x", "y", 2.0, ["r1", "r2"]), ("x", "z", 1.0, ["r3"]), ("q", "z", 1.0, ["r4"])], "src string, dst string, weight double, relation_hashes array<string>"),
        "paragraph_relation": spark.createDataFrame([("p1", "r1"), ("p2", "r3"), ("p3", "r2"), ("p1", "r4"), ("p3", "r4")], "paragraph_hash string, relation_hash string"),
        "paragraph_entity": spark.createDataFrame([("p1", "e1"), ("p3", "e2")], "paragraph_hash string, entity_hash string"),
        "entity": spark.createDataFrame([("e1",), ("e2",), ("e3",)], "hash string"),
        "vector": spark.createDataFrame([("p1",), ("r1",), ("r2",), ("e1",)], "hash string"),
    }
    out = dml.delete_source(store, "a")
    assert not any("paragraph_hash" in out[t]._jdf.queryExecution().optimizedPlan().toString() for t in ("relation", "edge"))
    keys = lambda t, *c: {tuple(r) for r in out[t].select(*c).collect()}
    assert keys("paragraph", "hash") == {("p3",)} and keys("relation", "hash") == {("r2",), ("r4",)}
    assert {(r.src, r.dst): r.relation_hashes for r in out["edge"].collect()} == {("x", "y"): ["r2"], ("q", "z"): ["r4"]}
    assert keys("paragraph_relation", "relation_hash", "paragraph_hash") == {("r2", "p3"), ("r4", "p3")}
    assert keys("entity", "hash") == {("e2",), ("e3",)} and keys("vector", "hash") == {("r2",)}
