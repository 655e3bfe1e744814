"""Weights that decay when read, and the engine's own counts."""

import random

from memspark.operators.decay import HOUR, DecayingEdges
from memspark.plans.engine import Engine
from memspark.plans.fixtures import Fixtures
from memspark.sources.snapshot import Snapshots


def test_ticks_equal_rewrites(spark, tmp_path):
    """Hourly ticks with strengthened edges between: the same weights as rewriting all edges every hour; each writes only what falls."""
    r = random.Random(3)
    edges = {(f"n{i % 15}", f"m{i}"): r.choice((0.101, 0.11, 0.2, 0.5, 3.0)) for i in range(60)}
    d = DecayingEdges(Snapshots(spark, f"file://{tmp_path}/e", buckets=8), half_life_h=4.0, below=0.1)
    t, factor = 1000 * HOUR + 1.0, 0.5 ** (1 / 4.0)
    d.put(spark.createDataFrame([(*k, w, [k[1]]) for k, w in edges.items()], "src string, dst string, weight double, relation_hashes array<string>"), t)
    fell, crossed = set(), set()
    for hour in range(1, 9):
        now, before = t + hour * HOUR, {k: w for k, w in edges.items() if w > 0}
        edges = {k: w * factor for k, w in edges.items()}
        if hour in (2, 5):
            some = {k: 0.3 for k in r.sample(sorted(before), 6)}
            d.shift(spark.createDataFrame([(*k, x) for k, x in some.items()], "src string, dst string, delta double"), now)
            edges |= {k: min(10.0, max(0.1, edges[k] + x)) for k, x in some.items()}
        gone, version = d.tick(now - HOUR, now)
        down = {k for k, w in edges.items() if 0 < w < 0.1}
        edges = {k: 0.0 if k in down else w for k, w in edges.items()}
        # A due row lies in the first whole hour after the fall, so a tick within that hour may see it at the next one.
        fell |= {(x.src, x.dst) for x in gone.collect()}
        crossed |= down
        got = {(x.src, x.dst): x.weight for x in d.read(now).collect()}
        assert got.keys() == edges.keys() and all(abs(got[k] - edges[k]) < 1e-9 or k in down for k in edges)
    d.tick(t + 8 * HOUR, t + 9 * HOUR)
    assert fell <= crossed | {k for k, w in edges.items() if w * factor < 0.1} and len(crossed) > 10
    same, version = d.tick(t + 9 * HOUR, t + 9 * HOUR)
    old = d.s.listing("edge_state", d.s.version())["buckets"]
    assert len({x["path"].split("/")[1] for x in old.values()}) > 1 and same.count() == 0


def test_counts_of_a_search(spark):
    """The observed rows are those of separate counts."""
    x = Fixtures(spark, "/root/testdata/sf0.001")
    e = Engine(x.store | {"paragraph_index": x.posting, "relation_index": x.relation_posting}, watch=True)
    q = x.queries.where("query_id = 100")
    found = e.search(q, paths_on=False).collect()
    told = {r.stage: r.rows for r in e.metrics().collect()}
    assert told["deduplicated"] == len(found) <= told["ranked"] <= told["above threshold"] <= told["fused"]
    assert told["paragraphs"] == e.paragraphs(q).count() and told["relations"] == e.relations(q).count()
    assert e.metrics().count() == 0


def test_sets_stay_where_they_are(spark, tmp_path):
    """Ticks and shifts write neither sets of hashes nor buckets that lack their edges; edges that come twice are put once."""
    d = DecayingEdges(Snapshots(spark, f"file://{tmp_path}/e", buckets=4), half_life_h=4.0, below=0.1)
    rows = [(f"n{i % 9}", f"m{i}", 0.11 if i % 2 else 2.0, [f"h{i}", "x"]) for i in range(40)]
    d.put(spark.createDataFrame([*rows, *rows[:3]], "src string, dst string, weight double, relation_hashes array<string>"), 0.0)
    sets = d.s.manifest()["tables"]["edge_set"]
    gone, _ = d.tick(0.0, 3 * HOUR)
    d.shift(spark.createDataFrame([("n1", "m1", 0.5), ("none", "m1", 0.5)], "src string, dst string, delta double"), 3 * HOUR)
    assert d.s.manifest()["tables"]["edge_set"] == sets and "relation_hashes" not in d.s.read("edge_state").columns
    assert gone.count() == 20 and d.s.read("edge_due").where("hour <= 3").count() == 0 and d.s.read("edge_due").count() == 21
    got = {(r.src, r.dst): (round(r.weight, 6), r.relation_hashes) for r in d.read(3 * HOUR).collect()}
    assert len(got) == 40 and got["n1", "m1"] == (0.5, ["h1", "x"]) and got["n3", "m3"] == (0.0, ["h3", "x"]) and got["n0", "m0"] == (round(2 * 0.5**0.75, 6), ["h0", "x"])
    again, version = d.tick(0.0, 3 * HOUR)
    assert again.count() == 0 and version == d.s.version()
