"""Operators do the whole job: no query, row or link beyond a fixed number is left out."""

import math
import re
from collections import Counter
from dataclasses import replace

import pytest
from memspark.config import Config
from memspark.operators import episode, knn, profile, sparse
from memspark.plans.engine import Engine
from memspark.plans.fixtures import Fixtures
from memspark.plans.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_episode_lexical_answers_every_query(spark):
    e = spark.createDataFrame([("e1", "about notes", ["k"], "s", ["Ann"], 1.0, 1.0)], "episode_id string, title string, keywords array<string>, summary string, participants array<string>, event_time_end double, updated_at double")
    q = spark.range(4500).select(F.col("id").alias("query_id"), F.lit("notes").alias("text"))
    got = episode.lexical(e, q)
    assert got.count() == got.select("query_id").distinct().count() == 4500
    assert got.where("episode_id = 'e1' and score = 4 and rank = 1").count() == 4500


def test_substring_search_answers_every_query(spark):
    d = spark.createDataFrame([("a", "green tea"), ("b", "coffee")], "hash string, content string")
    q = spark.range(4500).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "tea").otherwise("coffee").alias("text"))
    got = sparse.substring_search(d, q)
    assert got.count() == 4500 and got.where("(query_id % 2 = 0) = (hash = 'a')").count() == 4500


def test_profile_resolve_matches_every_key(spark):
    p = spark.range(2500).select(F.concat(F.lit("p"), "id").alias("person_id"), F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("m"), "id").alias("nickname"), F.format_string('[{"group_nick_name": "Big <%d>"}]', "id").alias("group_nicks"))
    w = spark.range(2500).select(F.concat(F.lit("<"), "id", F.lit(">")).alias("key"))
    got = profile.resolve(p, w)
    assert got.count() == 2500 and got.where("person_id = concat('p', substring(key, 2, length(key) - 2))").count() == 2500


def test_sparse_recall_ranks_only_rows_in_the_window(spark):
    """Ninety short rows score better, but are deleted, too early or of another source."""
    rows = [(f"h{i:03d}", "tea", "s1" if i % 3 else "s2", i % 3 == 1, 50.0 if i % 3 == 0 else 5.0) for i in range(90)] + [("hit", "tea " + "and other words " * 9, "s1", False, 50.0), ("none", "coffee", "s1", False, 50.0)]
    p = spark.createDataFrame(rows, "hash string, content string, source string, is_deleted boolean, created_at double").selectExpr("*", "cast(null as double) event_time", "cast(null as double) event_time_start", "cast(null as double) event_time_end")
    v = spark.createDataFrame([], "hash string, item_type string, embedding array<float>")
    q = spark.createDataFrame([(1, "tea", None)], "query_id int, text string, embedding array<float>")
    config = Config(sparse=replace(Config().sparse, candidate_k=1))
    got = Engine({"paragraph": p, "vector": v}, config).paragraphs(q, lower=40.0, upper=60.0, source="s1").collect()
    assert [r.hash for r in got] == ["hit"]


def test_bm25_of_every_100th_whole_text(spark):
    """Against brute force: 64 first distinct words of the whole text, all paragraphs."""
    words = lambda t: re.findall(r"\w+", t.lower())
    x = Fixtures(spark, SF)
    docs = {r.hash: words(r.content) for r in x.para.select("hash", "content").collect()}
    asked = {r.query_id: list(dict.fromkeys(words(r.text)))[:64] for r in x.queries.where("text != ''").collect()}
    assert set(asked) == set(range(0, 200, 100)) and max(map(len, asked.values())) > 12
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    tf = {h: Counter(ts) for h, ts in docs.items()}
    df = Counter(t for c in tf.values() for t in c)
    want = {}
    for q, ts in asked.items():
        scores = {h: sum(max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(docs[h]) / mean)) for t in ts if t in c) for h, c in tf.items() if any(t in c for t in ts)}
        want |= {(q, h): s for s, h in sorted(((s, h) for h, s in scores.items()), key=lambda y: (-y[0], y[1]))[:80]}
    got = {(r.query_id, r.hash): r.score for r in QUERIES["bm25_paragraphs"](spark, SF).collect()}
    assert len(got) == len(want)
    assert sorted(got.values()) == pytest.approx(sorted(want.values()), abs=2e-6)
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in got.keys() & want.keys()) and len(got.keys() & want.keys()) >= 0.95 * len(want)


def test_hybrid_search_asks_with_every_100th_row_and_for_relations(spark):
    got = QUERIES["hybrid_search"](spark, SF).toPandas()
    assert {0, 100, 200, 300, 400} <= set(got.query_id) and (got.query_id < 0).sum() > 0
    assert {"paragraph", "relation"} <= set(got.result_type)


def test_lsh_recall_with_its_defaults(spark):
    """Recall of the ten nearest over the whole 64-dimensional table, every 100th row asking."""
    x = Fixtures(spark, "/root/testdata/sf0.1")
    near = {q: {(r.query_id, r.hash) for r in search(x.vector, x.queries, 10).collect()} for q, search in (("exact", knn.search), ("lsh", knn.lsh_search))}
    recall = len(near["exact"] & near["lsh"]) / len(near["exact"])
    print(f"recall {recall}")
    assert len(near["exact"]) == 200 and recall >= 0.9


def test_links_reach_all_paragraphs(spark):
    """At sf0.1 links are spread over all documents: some have many, some none."""
    x = Fixtures(spark, "/root/testdata/sf0.1")
    n, m = x.para.count(), x.table("documents").count()
    for links in (x.paragraph_entity, x.paragraph_relation):
        ids = links.select(F.col("paragraph_hash").alias("hash")).distinct().join(x.para, "hash")
        assert 0.6 * n < ids.count() < n and ids.where(f"doc_id >= {m} / 2").count() > 0.25 * n


def test_words_come_from_all_lines(spark):
    x = Fixtures(spark, SF)
    assert x.words.agg(F.sum("score")).first()[0] == pytest.approx(x.table("lineitem").agg(F.sum("l_quantity") / 100).first()[0])
    assert QUERIES["fuse_rrf"](spark, SF).count() > 0


def test_participants_number_no_source(spark):
    """no row number over all paragraphs of a source, which would be one task."""
    plan = QUERIES["episode_participants"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(source#" in plan and not re.search(r"windowspecdefinition\(source#\d+L?, doc_id#", plan)
