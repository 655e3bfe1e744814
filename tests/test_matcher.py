"""Many patterns in many texts, against brute force."""

import random
from collections import Counter

import pytest
from memspark.operators import graph, matcher, profile
from memspark.plans.fixtures import Fixtures
from pyspark.sql import functions as F


def brute(texts, patterns):
    out = Counter()
    for i, t in texts:
        for p in {p for p in patterns if p}:
            at = (t or "").find(p)
            while at >= 0:
                out[i, p, at] += 1
                at = t.find(p, at + 1)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_place(spark, seed, monkeypatch):
    """Lengths 1 to 70, overlaps, code points beyond 16 bits, ends and beginnings, nulls, rows with one id."""
    r = random.Random(seed)
    monkeypatch.setattr(matcher, "PIECE", 300)
    monkeypatch.setattr(matcher, "OUT", 7)
    letters = "ab" if seed == 1 else "abcé中\U0001f600 \n"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    texts = [(i % 40, word(r.choice((0, 1, 2, 5, 40, 300)))) for i in range(60)] + [(99, None), (98, "aaaaaaaa"), (97, "\0ab\0")]
    some = [t for _, t in texts if t and len(t) > 80]
    patterns = [word(r.randint(1, 6)) for _ in range(30)] + [t[a : a + r.choice((7, 8, 9, 33, 70))] for t in some for a in (0, 11, len(t) - 70)] + ["aa", "", None, "a", "b\0"]
    got = matcher.occurrences(spark.createDataFrame(texts, "id int, text string").repartition(3), spark.createDataFrame([(p,) for p in patterns + patterns[:5]], "pattern string"))
    assert Counter((x.id, x.pattern, x["at"]) for x in got.collect()) == brute(texts, [p for p in patterns if p])


def test_nothing(spark):
    t, p = spark.createDataFrame([(1, "abc")], "id int, text string"), spark.createDataFrame([("x",)], "pattern string")
    assert matcher.occurrences(t, p).count() == matcher.occurrences(t, p.limit(0)).count() == matcher.occurrences(t.limit(0), p).count() == 0
    assert matcher.occurrences(t, spark.createDataFrame([("y" * 5000,), ("abc",)], "pattern string")).count() == 1


def test_what_is_shuffled_grows_with_hits(spark):
    """Of whole documents and all names of sf0.1, little more than true places leave their task."""
    x = Fixtures(spark, "/root/testdata/sf0.1")
    texts = x.table("documents").where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "text").unionByName(x.table("customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").cast("bigint").alias("query_id"), F.concat(F.lit("of "), "c_name", F.lit(" in")).alias("text")))
    hits = graph.mentions(texts, x.node)
    total = hits.agg(F.sum("n")).first()[0]
    low = texts.select(F.col("query_id").alias("id"), F.lower("text").alias("text"))
    plan = matcher.occurrences(low, x.node, "id", "text", "canon")
    assert plan.count() == total > 100
    found = matcher.keys(x.node.select(F.col("canon").alias("pattern")).where("canon != ''").distinct())
    shared = found.groupBy("level", "h").count().agg(F.max("count")).first()[0]
    assert shared <= 4 and found.count() == x.node.where("canon != ''").select("canon").distinct().count()


def test_person_keys(spark):
    p = spark.createDataFrame([("p1", "Ann", "annie", '[{"group_nick_name": "Big Ann"}]'), ("p2", "Bob", None, None)], "person_id string, name string, nickname string, group_nicks string")
    k = spark.createDataFrame([(x,) for x in ("p2", "ANNIE", " g an", "nobody", "")], "key string")
    assert {r.key: r.person_id for r in profile.resolve(p, k).collect()} == {"p2": "p2", "ANNIE": "p1", " g an": "p1", "": "p1"}
