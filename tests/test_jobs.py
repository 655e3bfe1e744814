"""Batch entry points and model hooks."""

import json

import pytest
from memspark.functions import text as tx
from memspark.operators import graph, hooks, profile
from memspark.plans import cli
from memspark.schemas import TABLES
from memspark.sources.snapshot import Snapshots
from pyspark.sql import functions as F

NOW = 1_000_000.0


def test_cli(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Paris是Lovely. Paris is Lovely. 'Old Town' 有 a river.")
    (tmp_path / "in/b.json").write_text(json.dumps({"paragraphs": ["Bare one", {"content": "Ann met Bob", "entities": ["Ann"], "source": "web"}], "entities": ["Zoe"], "relations": [{"subject": "Ann", "predicate": "met", "object": "Bob"}]}))
    assert cli.run(spark, root, "import-files", [f"{tmp_path}/in"], NOW) == 1
    assert cli.run(spark, root, "import-json", [f"{tmp_path}/in"], NOW) == 2
    s = Snapshots(spark, root)
    assert s.read("paragraph").count() == 3 and s.read("relation").count() == 2 and s.read("edge").count() == 2
    assert {"Zoe", "Ann", "Paris"} <= {r.name for r in s.read("entity").collect()}
    assert cli.run(spark, root, "backfill-times", [], NOW) == 3 and s.read("paragraph").where("event_time is null").count() == 0
    cli.run(spark, root, "backfill-vectors", [], NOW)
    assert cli.run(spark, root, "check", ["64"]).first().ok and cli.run(spark, root, "audit", []).where("kind = 'relation'").first().covered == 2
    cli.run(spark, root, "rebuild-episodes", [], NOW)
    assert s.read("episode").count() == cli.run(spark, root, "sources", []).count()
    cli.run(spark, root, "delete-source", ["web"], NOW)
    assert s.read("paragraph").where("source = 'web'").count() == 0
    hits = s.read("relation").where("predicate = 'met'").select("hash", F.lit(3).alias("hits"))
    hits.write.parquet(f"{tmp_path}/hits")
    cli.run(spark, root, "maintain", [f"{tmp_path}/hits"], NOW)
    assert [r.predicate for r in s.read("relation").where(f"last_reinforced = {NOW}").collect()] == ["met"]
    assert "paragraph_entity" not in {t for t, v in s.manifest()["tables"].items() if s.manifest()["commit_id"] in v["path"]}
    (tmp_path / "in/c.json").write_text("no json")
    at = s.version()
    with pytest.raises(ValueError):
        cli.run(spark, root, "import-json", [f"{tmp_path}/in", f"{tmp_path}/bad", "0"], NOW)
    assert s.version() == at and [r.content for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == ["no json"]
    with pytest.raises(ValueError):
        cli.run(spark, root, "other", [])


def test_hooks(spark):
    c = spark.createDataFrame([("a",), ("b",), (None,)], "text string")
    answer = {"a": 'x {"triples": [{"subject": "s", "predicate": "p", "object": "o"}], "entities": ["e"]} y'}
    got = {r.text: r.extracted for r in hooks.extract(c, lambda ts: [answer.get(t, "no") for t in ts]).collect()}
    assert got["a"].triples[0].subject == "s" and got["a"].entities == ["e"] and got["b"] is None and got[None] is None
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x

    assert hooks.retried(flaky, sleep=lambda s: None)(7) == 7 and len(calls) == 3
    v = c.where("text is not null").select(F.col("text").alias("hash"), hooks.embedder(lambda ts: [[float(len(t)), 1.0] for t in ts])(F.col("text")).alias("embedding"))
    assert hooks.self_check(v, 2).first().ok and not hooks.self_check(v, 3).first().ok
    assert {r.ok for r in hooks.drift(v, v).collect()} == {True}
    assert spark.createDataFrame([("Quote", "x"), ("", "a|b|c")], "h string, c string").select(tx.type_from_hint(F.col("h"), F.col("c")).alias("k")).collect()[0].k == "quote"


def test_refresh(spark):
    p = spark.createDataFrame([("p1", "Ann", None, None), ("p2", "Bob", None, None)], "person_id string, name string, nickname string, group_nicks string")
    active = spark.createDataFrame([("s", "u", "p1", NOW), ("s", "v", "p2", NOW)], TABLES["active_person"])
    on = spark.createDataFrame([("s", "u", True, 1.0), ("s", "v", False, 1.0)], TABLES["profile_switch"])
    rel = spark.createDataFrame([("h", "Ann", "likes", "tea", 1.0, False)], "hash string, subject string, predicate string, object string, confidence double, is_inactive boolean")
    hits = spark.createDataFrame([], "person_id string, hash string, score double")
    par = spark.createDataFrame([], "hash string, content string")
    none = spark.createDataFrame([], TABLES["profile_snapshot"])
    one = profile.refresh(p, active, on, none, rel, hits, par, NOW)
    assert [r.person_id for r in one.collect()] == ["p1"]
    assert profile.refresh(p, active, on, one, rel, hits, par, NOW + 60).count() == 1
    assert {r.enabled for r in profile.injection_enabled(active.select("stream_id", "user_id"), on).collect()} == {True, False}
    q = spark.createDataFrame([(1, "ann and ann")], "query_id int, text string")
    assert graph.query_seeds(q, spark.createDataFrame([("ann", "Ann")], "canon string, name string")).first().weight == 2.0
