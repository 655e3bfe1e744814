"""Bucketed copy-on-write snapshots."""

import os
import random

import pytest
from memspark.schemas import KEYS, TABLES
from memspark.sources.snapshot import Snapshots
from pyspark.sql import functions as F


def files(root):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet"))


def test_one_row_writes_one_bucket(spark, tmp_path):
    """Of a million rows, one changed row costs one bucket; readers of either version see all of theirs."""
    s = Snapshots(spark, f"file://{tmp_path}/s", buckets=32)
    n = 1_000_000
    s.commit({"node": spark.range(n).select(F.concat(F.lit("n"), "id").alias("canon"), F.lit("old").alias("name"))})
    before, size = set(files(f"{tmp_path}/s")), sum(os.path.getsize(f) for f in files(f"{tmp_path}/s"))
    assert s.change({"node": spark.createDataFrame([("n77", "new")], "canon string, name string")}) == 2
    new = set(files(f"{tmp_path}/s")) - before
    assert len({os.path.dirname(f) for f in new}) == 1 and sum(map(os.path.getsize, new)) < 2 * size / 32
    a, b = s.listing("node", 1), s.listing("node", 2)
    assert len(a["buckets"]) == 32 and sum(x["path"] != b["buckets"][k]["path"] for k, x in a["buckets"].items()) == 1
    assert s.read("node", 1).where("name = 'new'").count() == 0 and s.read("node").where("name = 'new'").count() == 1
    assert s.read("node", 1).count() == s.read("node").count() == n
    one = s.read("node", buckets=s.buckets_of("node", spark.createDataFrame([("n77",)], "canon string")))
    assert one.where("canon = 'n77'").first().name == "new" and one.count() < 2 * n / 32


def test_replace_overwrites_only_its_source(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/s", buckets=8)
    some = lambda src, ids, title: spark.createDataFrame([(f"{src}{i}", src, title) for i in ids], "episode_id string, source string, title string")
    full = lambda df: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], TABLES["episode"]).schema])
    first = full(some("a", range(4), "x").unionByName(some("b", range(3), "x")).unionByName(some("c", range(2), "x")))
    s.commit({"episode": first})
    scope = spark.createDataFrame([("a",), ("zz",)], "source string")
    s.change(replaces={"episode": (scope, full(some("a", range(9, 11), "y")))})
    got = {(r.episode_id, r.title) for r in s.read("episode").collect()}
    assert got == {("a9", "y"), ("a10", "y")} | {(f"b{i}", "x") for i in range(3)} | {(f"c{i}", "x") for i in range(2)}
    touched = set(s.buckets_of("episode", scope))
    old, new = (s.listing("episode", v)["buckets"] for v in (1, 2))
    assert all(old[k] == new[k] for k in old if int(k) not in touched)


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_against_brute_force(spark, tmp_path, seed):
    """Rounds of upserts and deletes, by whole and by half keys, with null keys; compaction and vacuum change no row."""
    r = random.Random(seed)
    s, want = Snapshots(spark, f"file://{tmp_path}/s", buckets=5), {}
    ddl = "paragraph_hash string, entity_hash string, mention_count int"
    for k in range(5):
        rows = {(f"p{r.randrange(12)}", f"e{r.randrange(4)}"): r.randrange(100) for _ in range(r.randint(0, 25))}
        gone = {f"e{r.randrange(4)}"} if k % 2 else set()
        want = {x: n for x, n in want.items() if x[1] not in gone} | rows
        s.change({"paragraph_entity": spark.createDataFrame([(*x, n) for x, n in rows.items()], ddl)}, deletes={"paragraph_entity": spark.createDataFrame([(x,) for x in gone], "entity_hash string")} if gone else None)
        assert {(x[0], x[1]): x[2] for x in s.read("paragraph_entity").collect()} == want and s.read("paragraph_entity").count() == len(want)
    last = s.version()
    assert s.compact("paragraph_entity", 3) == last + 1 and s.listing("paragraph_entity")["n"] == 3
    assert s.vacuum(1) > 0 and {(x[0], x[1]): x[2] for x in s.read("paragraph_entity").collect()} == want
    s.change({"paragraph_entity": spark.createDataFrame([("p1", "e1", 7), ("p1", "e1", 7)], ddl)})
    assert s.read("paragraph_entity").where("paragraph_hash = 'p1' and entity_hash = 'e1'").count() == 1


def test_ranges_guards_and_conflicts(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/s", buckets=4)
    nodes = spark.createDataFrame([(f"n{i:02d}", "x") for i in range(40)], "canon string, name string")
    s.commit({"node": nodes})
    assert s.read("node", between=("n10", "n12")).count() == 3 and s.read("node", between=("x", "z")).count() == 0
    with pytest.raises(ValueError):
        s.commit({"node": nodes}, buckets={"node": [0]})
    assert s.version() == 1 and s.read("node").count() == 40
    with pytest.raises(RuntimeError):
        s.change({"node": nodes.limit(1)}, expected=7)
    s.change(deletes={"node": nodes.select("canon")})
    assert s.read("node").count() == 0 and s.listing("node")["buckets"] == {}
    s.change({"node": nodes.limit(3)})
    assert s.read("node").count() == 3
    assert all(set(by) <= set(f.split()[0] for f in TABLES[t].split(", ")) for t, (by, keys) in KEYS.items())
