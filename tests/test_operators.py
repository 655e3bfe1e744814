"""Operators on hand-made stores: writes, graph, fusion folds, episodes, lifecycle, chunkers, ingest, streaming."""

import hashlib
import random
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from memspark.config import Config, Episode, Threshold
from memspark.operators import catalog, chunk, dml, episode, evaluate, fusion, graph, ivf, joins, knn, lifecycle, profile, sparse, threshold
from memspark.plans.engine import Engine
from memspark.schemas import TABLES, validate
from memspark.sources import ingest, readers
from memspark.sources.snapshot import Snapshots, verify
from memspark.streaming import jobs
from pyspark.sql import functions as F

NOW = 1_000_000.0


@pytest.fixture(scope="module")
def store(spark):
    items = spark.createDataFrame(
        [(0, "Ann knows Bob.", "s1", ["Ann", "bob", "ANN"], [("Ann", "knows", "Bob")]), (1, "Bob likes tea.", "s1", ["Bob"], [("Bob", "likes", "Tea"), ("bob", "likes", "tea")]), (2, "Ann  knows Bob.", "s2", [], []), (3, "Nothing here.", "s2", [], [])],
        "ord int, content string, source string, entities array<string>, relations array<struct<subject:string,predicate:string,object:string>>",
    ).withColumn("knowledge_type", F.lit("factual"))
    empty = {t: spark.createDataFrame([], ddl) for t, ddl in TABLES.items()}
    out = ingest.persist(empty, items, NOW)
    pairs = out["relation"].select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.lit(1.0).alias("weight"), "hash", F.lit(0).alias("ord"))
    out["edge"] = graph.build_edges(pairs)
    out["node"] = graph.build_nodes(out["entity"].select("name", F.lit(0).alias("ord")))
    return {k: v.cache() for k, v in out.items()}


def test_persist(store):
    assert {r.content for r in store["paragraph"].collect()} == {"Ann knows Bob.", "Bob likes tea.", "Nothing here."}
    assert {(r.name.lower(), r.appearance_count) for r in store["entity"].collect()} == {("ann", 2), ("bob", 5), ("tea", 2)}
    assert store["relation"].count() == 2 and store["paragraph_relation"].count() == 2
    assert {r.dangling for r in verify(store).collect()} == {0}


def test_persist_again_keeps_first(spark, store):
    again = spark.createDataFrame([(9, "Ann knows Bob.", "other", [], [("ann", "KNOWS", "bob")])], "ord int, content string, source string, entities array<string>, relations array<struct<subject:string,predicate:string,object:string>>")
    dead = store | {"paragraph": dml.mark_deleted(store["paragraph"], store["paragraph"].select("hash"), NOW)}
    out = ingest.persist(dead, again, NOW + 1)
    row = {r.content: r for r in out["paragraph"].collect()}
    assert row["Ann knows Bob."].source == "s1" and not row["Ann knows Bob."].is_deleted and row["Nothing here."].is_deleted
    assert out["relation"].count() == 2 and len(row) == 3


def test_delete_deep(store):
    gone = store["paragraph"].where("content = 'Bob likes tea.'").select("hash")
    out, also = dml.delete_paragraphs_deep(store, gone)
    assert [r.predicate for r in out["relation"].collect()] == ["knows"] and out["paragraph"].count() == 2
    assert [(r.src, r.dst) for r in also["edges"].collect()] == [("bob", "tea")] and also["vectors"].count() == 2
    left = dml.delete_source(store, "s1")
    assert left["entity"].count() == 0 and left["paragraph"].count() == 1
    one, n = dml.delete_by_content(store, F.lit("Nothing   here."))
    assert n == 1 and one["paragraph"].count() == 2
    by_name = dml.resolve_entities(store["entity"], store["entity"].sparkSession.createDataFrame([("  BOB ",), ("nobody",)], "spec string"))
    assert [r.spec for r in by_name.collect()] == ["  BOB "]
    assert dml.delete_entities(store, store["entity"].where("lower(name) = 'tea'").select("hash"))["relation"].where("predicate = 'likes' and object = 'Tea'").count() == 0


def test_recycle_and_restore_is_identity(store):
    h = store["relation"].limit(1).select("hash")
    there = dml.recycle(store, h, NOW)
    assert there["relation"].count() == 1 and there["deleted_relation"].count() == 1
    back = dml.restore(there, h)
    assert sorted(back["relation"].collect()) == sorted(store["relation"].collect()) and back["deleted_relation"].count() == 0
    assert catalog.recycle_bin(there["deleted_relation"], store["entity"]).count() == 1
    whole = lifecycle.restore_memory(there | {"edge": graph.deactivate(there["edge"], there["edge"])}, h)
    assert whole["edge"].where("weight > 0").count() == 1


def test_states_and_flags(spark, store):
    h = store["relation"].select("hash")
    ch = h.select("hash", F.lit("failed").alias("state"), F.lit("oops").alias("error"), F.lit(True).alias("bump"))
    r = dml.set_vector_state(store["relation"], ch, NOW).first()
    assert (r.vector_state, r.vector_error, r.vector_retry_count) == ("failed", "oops", 1)
    assert dml.set_vector_state(store["relation"], ch.withColumn("state", F.lit("wrong")), NOW).where("vector_state = 'wrong'").count() == 0
    rel, vec = dml.add_missing_vectors(store["relation"], store["vector"], readers.hashing_embedder(16), NOW)
    assert vec.count() == 2 and {x.vector_state for x in rel.collect()} == {"ready"}
    good, bad = validate(rel, "vector_state", ("ready",))
    assert good.count() == 2 and bad.count() == 0
    uniq, clash = dml.hash_aliases(store["relation"])
    v = spark.createDataFrame([(uniq.first().alias,), ("zz",)], "value string")
    assert {r.value: r.hash for r in dml.resolve_alias(v, store["relation"], uniq).collect()}["zz"] == "" and clash.count() == 0


def test_last_writes(spark):
    a = spark.createDataFrame([("s", "u", True, 1.0)], TABLES["profile_switch"])
    b = spark.createDataFrame([("s", "u", False, 2.0), ("s", "v", True, 0.5)], TABLES["profile_switch"])
    assert {(r.user_id, r.enabled) for r in dml.last_write(a, b, ["stream_id", "user_id"], "updated_at").collect()} == {("u", False), ("v", True)}
    o = spark.createDataFrame([("p", "old", 1.0, "", "")], TABLES["profile_override"])
    n = spark.createDataFrame([("p", " ", 2.0, "", "")], TABLES["profile_override"])
    assert dml.set_overrides(o, n).count() == 0


def test_graph_edits(spark, store):
    e = store["edge"]
    assert dml.rename_node(e, "Bob", "Robert").where("src = 'robert' or dst = 'robert'").count() == 2
    assert dml.set_edge(e, "x", "y", 2.0).count() == 3 and dml.set_edge(e, "Ann", "Bob", None).count() == 1
    ch = spark.createDataFrame([("ann", "bob", -5.0), ("n", "m", -1.0), ("q", "r", 20.0)], "src string, dst string, delta double")
    assert {(r.src, r.weight) for r in graph.shift_weights(e, ch).collect()} == {("ann", 0.1), ("bob", 1.0), ("q", 10.0)}
    last = spark.createDataFrame([("a", "b", 1.0, "h", 0), ("A", "b", 5.0, "i", 1)], "src string, dst string, weight double, hash string, ord int")
    assert graph.build_edges(last, "last").first().weight == 5.0 and graph.build_edges(last).first().weight == 6.0
    assert graph.counts(store["node"], e).first().density == pytest.approx(2 / 6)
    bands = graph.saliency_filter(spark.createDataFrame([(f"n{i}", 1.0 / (i + 1)) for i in range(10)], "node string, score double"), e, 0.3)
    assert {r.band: r["count"] for r in bands.groupBy("band").count().collect()} == {"kept": 3, "ghost": 2, "dropped": 5}


def brute_rank(edges, nodes, seeds, rounds, alpha=0.85):
    out = {}
    for s, _, w in edges:
        out[s] = out.get(s, 0) + w
    rank = dict(seeds)
    for _ in range(rounds):
        flow = dict.fromkeys(nodes, 0.0)
        for s, d, w in edges:
            flow[d] += alpha * rank.get(s, 0) * w / out[s]
        rest = 1 - sum(flow.values())
        rank = {n: flow[n] + rest * seeds.get(n, 0) for n in nodes}
    return rank


def test_pagerank(spark):
    r = random.Random(4)
    nodes = [f"n{i}" for i in range(12)]
    edges = [(a, b, r.random()) for a in nodes[:9] for b in nodes if a != b and r.random() < 0.25]
    e = spark.createDataFrame(edges, "src string, dst string, weight double").withColumn("relation_hashes", F.array().cast("array<string>"))
    n = spark.createDataFrame([(x, x) for x in nodes], "canon string, name string")
    got = {x.node: x.score for x in graph.pagerank(e, n).collect()}
    want = brute_rank(edges, nodes, dict.fromkeys(nodes, 1 / 12), 60)
    assert all(abs(got[x] - want[x]) < 1e-5 for x in nodes)
    seeds = spark.createDataFrame([("q", "N1", 3.0), ("q", "n2", 1.0), ("lost", "zz", 1.0)], "query_id string, node string, weight double")
    mine = {(x.query_id, x.node): x.score for x in graph.pagerank(e, n, seeds, iterations=8, tol=0).collect()}
    for q, s in (("q", {"n1": 0.75, "n2": 0.25}), ("lost", dict.fromkeys(nodes, 1 / 12))):
        w = brute_rank(edges, nodes, s, 8)
        assert all(abs(mine.get((q, x), 0.0) - w[x]) < 1e-9 for x in nodes)


def test_entities_in_queries(spark):
    n = spark.createDataFrame([("ann", "Ann"), ("ann lee", "Ann Lee"), ("tea", "Tea"), ("aa", "AA")], "canon string, name string")
    q = spark.createDataFrame([(1, "Ann Lee likes tea"), (2, "aaa"), (3, None)], "query_id int, text string")
    assert {(r.query_id, r.canon): r.n for r in graph.mentions(q, n).collect()} == {(1, "ann"): 1, (1, "ann lee"): 1, (1, "tea"): 1, (2, "aa"): 2}
    assert [(r.query_id, r.canon) for r in graph.token_entities(q, n).orderBy("query_id", "position").collect()] == [(1, "ann lee"), (1, "tea")]
    assert [r.canon for r in graph.seed_entities(q, n).where("query_id = 1").orderBy("rank").collect()] == ["ann lee", "ann"]


def results(spark, rows, ddl="query_id int, hash string, score double"):
    return spark.createDataFrame(rows, ddl)


@settings(deadline=None, max_examples=10)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=12))
def test_minmax_and_threshold(spark, scores):
    df = results(spark, [(1, f"h{i:02d}", s) for i, s in enumerate(scores)])
    assert all(0 <= r.score <= 1 for r in fusion.minmax(df).collect())
    t = threshold.thresholds(df).first().threshold
    assert 0.3 <= t <= 0.95
    kept = {r.hash for r in threshold.adaptive(df).collect()}
    above = {f"h{i:02d}" for i, s in enumerate(scores) if s >= t}
    best = {f"h{i:02d}" for i in sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:3]}
    assert kept == (above if len(above) >= 3 else best)


def test_gap_rule(spark):
    df = results(spark, [(1, h, s) for h, s in zip("abcd", (0.9, 0.8, 0.3, 0.29))])
    assert threshold.thresholds(df).first().by_gap == 0.29
    assert threshold.thresholds(df, Threshold(gap_mode="largest")).first().by_gap == 0.3


def test_rrf_passes_a_single_list(spark):
    a, b = results(spark, [(1, "x", 0.4), (2, "y", 0.5)]), results(spark, [(2, "z", 0.9)])
    got = {(r.query_id, r.hash): r.score for r in fusion.rrf([(a, 0.7), (b, 0.3)]).collect()}
    assert got[1, "x"] == 0.4 and got[2, "y"] == 1.0 and got[2, "z"] == 0.0


def test_content_dedup(spark):
    rows = [(1, "a", 1, "long text here"), (1, "b", 2, "text"), (1, "c", 3, ""), (1, "d", 4, "other"), (1, "e", 5, "and other things"), (2, "f", 1, " "), (2, "g", 2, None)]
    df = results(spark, rows, "query_id int, hash string, rank int, content string")
    assert {r.hash for r in fusion.content_dedup(df).collect()} == {"a", "d", "f"}


def test_pair_rerank(spark):
    rel = results(spark, [("a", "S", "O"), ("b", "s", "o"), ("c", "s", "o"), ("d", "x", "y")], "hash string, subject string, object string")
    rows = [(1, "a", 0.9, "relation", 1), (1, "p", 0.85, "paragraph", 2), (1, "b", 0.8, "relation", 3), (1, "c", 0.7, "relation", 4), (1, "d", 0.6, "relation", 5)]
    got = fusion.pair_rerank(results(spark, rows, "query_id int, hash string, score double, result_type string, rank int"), rel, 1)
    assert [r.hash for r in got.orderBy("rank").collect()] == ["a", "p", "d", "b", "c"]


def test_ppr_rerank_and_paths(spark):
    res = results(spark, [(1, "p", 0.5, "paragraph", 1), (1, "q", 0.4, "paragraph", 2)], "query_id int, hash string, score double, result_type string, rank int")
    bridge = results(spark, [("p", "e"), ("p", "f")], "paragraph_hash string, entity_hash string")
    ppr = results(spark, [(1, "e", 1.0), (1, "f", 0.5)], "query_id int, entity_hash string, ppr double")
    assert {r.hash: round(r.score, 6) for r in fusion.ppr_rerank(res, bridge, ppr).collect()} == {"p": 0.575, "q": 0.4}
    extra = results(spark, [(1, "path")], "query_id int, hash string")
    assert [r.hash for r in fusion.with_paths(res, extra).orderBy("rank").collect()] == ["path", "p", "q"]
    assert fusion.with_paths(res, extra, threshold=0.1).count() == 2


def test_adjusted_threshold(spark):
    h = spark.createDataFrame([("s", i, t) for i, t in enumerate([0.5, 0.5, 0.9])], "stream string, at int, threshold double")
    assert [round(r.threshold, 6) for r in threshold.adjusted(h).orderBy("at").collect()] == [0.5, 0.5, 0.7]


def test_sparse_fallbacks(spark):
    d = spark.createDataFrame([("a", "green tea"), ("b", "black coffee"), ("c", None)], "hash string, content string")
    q = spark.createDataFrame([(1, "tea"), (2, "cof"), (3, "")], "query_id int, text string")
    best = sparse.bm25(d, q)
    assert {(r.query_id, r.hash) for r in best.collect()} == {(1, "a")}
    both = sparse.with_fallback(best, sparse.substring_search(d, q), q)
    assert {(r.query_id, r.hash) for r in both.collect()} == {(1, "a"), (2, "b")}
    assert {r.query_id: r.use_sparse for r in sparse.gate(q, results(spark, [(1, "a", 0.9)])).collect()} == {1: False, 2: True, 3: True}
    assert not sparse.index_stale(d, sparse.ngram_index(d)).first().stale


def test_knn(spark):
    r = random.Random(2)
    vec = [(f"v{i}", "paragraph", [r.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [("bad", "paragraph", [float("nan")] * 8), ("short", "paragraph", [1.0])]
    v = spark.createDataFrame(vec, "hash string, item_type string, embedding array<float>")
    q = spark.createDataFrame([(i, vec[i][2]) for i in range(5)], "query_id int, embedding array<float>")
    exact = knn.search(v, q, 10, dim=8).collect()
    assert all(x.hash == f"v{x.query_id}" for x in exact if x.rank == 1) and len(exact) == 50
    near = {(x.query_id, x.hash) for x in knn.lsh_search(v.where("hash not in ('bad', 'short')"), q, 10, planes=2, tables=10).collect()}
    assert len(near & {(x.query_id, x.hash) for x in exact}) >= 45
    assert knn.needs_compaction(3000, 1001) and not knn.needs_compaction(3000, 900)
    assert knn.add(v.limit(1), v, 8).count() == 300


def test_knn_of_itself(spark):
    v = spark.createDataFrame([(f"v{i}", "p", [float(i), 1.0]) for i in range(20)], "hash string, item_type string, embedding array<float>")
    q = v.select(F.col("hash").alias("query_id"), "embedding")
    assert knn.search(v, q, 1).where("query_id = hash").count() == 20
    assert ivf.synonyms(v, 0.999).where("src < dst").count() > 0


def brute_groups(rows, most, chars, window):
    out, g, n, c, last = {}, 0, 0, 0, None
    for a, h, size in sorted(rows):
        if n and (n >= most or c + size > chars or a - last > window):
            g, n, c = g + 1, 0, 0
        n, c, last = n + 1, c + size, a
        out[h] = g
    return out


@settings(deadline=None, max_examples=8)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 30)), max_size=25), st.integers(1, 5), st.integers(1, 60), st.integers(0, 10))
def test_episode_groups(spark, rows, most, chars, window):
    data = [("s", f"h{i:02d}", float(a), "x" * n) for i, (a, n) in enumerate(rows)]
    df = spark.createDataFrame(data, "source string, hash string, created_at double, content string").selectExpr("*", "cast(null as double) event_time", "cast(null as double) event_time_start", "cast(null as double) event_time_end")
    got = {r.hash: r.group_no for r in episode.group(df, Episode(most, chars, window)).collect()}
    assert got == brute_groups([(a, h, len(c)) for _, h, a, c in data], most, chars, window)


def test_episode_queue(spark):
    q = spark.createDataFrame([], TABLES["rebuild_source"])
    s = spark.createDataFrame([(" a ",), ("a",), ("b",), ("",)], "source string")
    q = episode.enqueue(q, s, 1.0)
    assert q.count() == 2
    out = q.select("source", "requested_at", F.when(F.col("source") == "a", "failed").otherwise("done").alias("status"), F.lit("e").alias("error"))
    done = episode.settle(episode.enqueue(q, s.where("source = 'b'"), 5.0), out, 6.0)
    row = {r.source: (r.status, r.retry_count) for r in done.collect()}
    assert row == {"a": ("failed", 1), "b": ("pending", 0)}
    assert [r.source for r in episode.fetch(done).collect()] == ["a", "b"]
    assert joins.visible_episodes(spark.createDataFrame([("e", "a", None, None, 1.0, ["x"])], "episode_id string, source string, event_time_start double, event_time_end double, updated_at double, participants array<string>"), done).count() == 0


def test_parse_segments(spark):
    raw = 'Sure: {"episodes": [{"title": "T", "summary": "S", "paragraph_hashes": ["a", "z", "a"], "participants": ["X", "x"], "time_confidence": 7}, {"title": "", "summary": "S", "paragraph_hashes": ["a"]}]} done'
    got = episode.parse_segments(spark.createDataFrame([(1, raw), (2, "no json")], "group_id int, raw string"), spark.createDataFrame([(1, "a"), (1, "b")], "group_id int, hash string")).collect()
    assert len(got) == 1 and got[0].paragraph_hashes == ["a"] and got[0].participants == ["X"] and got[0].time_confidence == 1.0


def test_maintenance(spark, store):
    hits = store["relation"].where("predicate = 'knows'").select("hash")
    one = lifecycle.reinforce(store, hits, NOW)
    r = one["relation"].where("predicate = 'knows'").first()
    assert r.last_reinforced == NOW and r.protected_until == NOW + 86400
    assert {x.src: round(x.weight, 6) for x in one["edge"].collect()} == {"ann": 1.9, "bob": 1.0}
    again = lifecycle.reinforce(one, hits, NOW + 10)
    assert again["edge"].where("src = 'ann'").first().weight == pytest.approx(1.9)
    weak = store | {"edge": graph.decay(store["edge"], 0.05)}
    frozen = lifecycle.freeze(weak, NOW)
    assert frozen["relation"].where("is_inactive").count() == 2 and frozen["edge"].where("weight = 0").count() == 2
    late = lifecycle.prune(frozen, NOW + 2 * 86400)
    assert late["relation"].count() == 0 and late["deleted_relation"].count() == 2 and late["edge"].where("size(relation_hashes) > 0").count() == 0
    pinned = weak | {"relation": lifecycle.protect(store["relation"], hits, NOW, 0)}
    assert lifecycle.freeze(pinned, NOW)["relation"].where("is_inactive").count() == 1
    tick = lifecycle.maintain(store, hits, NOW)
    assert tick["relation"].count() == 2 and lifecycle.decay_factor(24, 24) == 0.5
    assert lifecycle.modify(store, hits, "forget", 1.0, NOW)["edge"].where("src = 'ann'").first().weight == 0.1


def test_orphans_are_marked_then_swept(store):
    old = store | {"paragraph": store["paragraph"].withColumn("created_at", F.lit(0.0))}
    one = lifecycle.collect_orphans(old, NOW)
    assert [r.content for r in one["paragraph"].where("is_deleted").collect()] == ["Nothing here."]
    assert lifecycle.collect_orphans(one | {"paragraph": one["paragraph"].withColumn("deleted_at", F.lit(0.0))}, NOW)["paragraph"].count() == 2


def test_chunkers():
    r = random.Random(3)
    for _ in range(40):
        text = "".join(r.choice(["word ", "x" * 90 + " ", "\n", "\n\n", "- item\n", "# Head\n", "Key: value\n", "Stop. "]) for _ in range(r.randint(0, 120)))
        f = list(chunk.factual(text))
        assert "\n".join(c[3] for c in f) == text if text else not [c for c in f if c[3]]
        assert all(text[a:z] == t for a, z, _, t in [*f, *chunk.quote(text), *chunk.narrative(text)])
        assert all(z - a <= 800 for a, z, _, _ in chunk.narrative(text))
        assert [c[3] for c in chunk.quote(text)] == [s for s in text.split("\n\n") if s.strip()]
        assert all(len(c[3]) <= 600 for c in chunk.sentences(text) if " " in c[3])


def test_chunk_split(spark):
    d = spark.createDataFrame([(1, "a\n\nb", "quote"), (2, None, "factual"), (3, "x" * 1700, "narrative")], "id int, content string, strategy string")
    got = chunk.split(d).collect()
    assert [(r.id, r.idx, r.text) for r in got if r.id == 1] == [(1, 0, "a"), (1, 1, "b")]
    assert [(r.start, r.end) for r in got if r.id == 3] == [(0, 800), (600, 1400), (1200, 1700)]
    m = chunk.match_patterns(spark.createDataFrame([(1, "abcabc"), (2, None)], "id int, text string"), ["abc", "bc", ""])
    assert sorted((r.pattern, r["at"]) for r in m.collect()) == [("abc", 0), ("abc", 3), ("bc", 1), ("bc", 4)]


def test_json_shapes(spark):
    files = spark.createDataFrame(
        [("a", '{"docs": [{"passage": "P one", "extracted_triples": [["s", "p", "o"], ["x"]], "extracted_entities": ["E", "e"]}]}'), ("b", '{"paragraphs": ["bare", {"content": " Item ", "type": "quote", "entities": ["Q"], "time_meta": {"event_time": "2024/01/01 10:00"}}, ""], "entities": ["Z"], "relations": [{"subject": "s", "predicate": "p", "object": ""}]}'), ("c", "junk")],
        "path string, raw string",
    )
    u = ingest.json_units(files)
    p = {r.content: r for r in u["paragraphs"].collect()}
    assert set(p) == {"P one", "bare", "Item"} and p["P one"].entities == ["E"] and len(p["P one"].relations) == 1
    assert p["Item"].knowledge_type == "quote" and p["Item"].time.time_granularity == "minute"
    assert [r.name for r in u["entities"].collect()] == ["Z"] and u["relations"].count() == 0


def test_regex_extraction(spark):
    e, r = ingest.extract_regex(spark.createDataFrame([("h", "Paris is Lovely and 'old town' was Rome")], "hash string, content string"))
    assert {x.name for x in e.collect()} == {"Paris", "Lovely", "Rome", "old town"}
    assert [(x.subject, x.predicate, x.object) for x in r.collect()] == [("Paris", "is", "Lovely")]


def test_chats_replay(spark):
    rows = spark.createDataFrame([(1, "c", 1.0, 2.0, '["Ann", "Bob"]', "Tea", '["green"]', "They talked."), (2, "c", 3.0, 4.0, "bad", "T", "[]", "x")], readers.CHAT_HISTORY)
    m = ingest.map_chats(rows)
    assert m["items"].count() == 1 and m["rejected"].count() == 1 and m["relations"].count() == 3
    empty = {t: spark.createDataFrame([], ddl) for t, ddl in TABLES.items()}
    one = {k: v.cache() for k, v in ingest.commit_window(empty, m, NOW).items()}
    two = ingest.commit_window(one, m, NOW + 1)
    for t in ("paragraph", "entity", "relation", "paragraph_entity", "paragraph_relation"):
        assert sorted(map(str, one[t].collect())) == sorted(map(str, two[t].collect()))
    assert rows.where(readers.selection(streams=[])).count() == 0


def test_files_and_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\ntwo")
    (tmp_path / "in/b.bin").write_text("no")
    f = readers.text_files(spark, str(tmp_path / "in"))
    assert [r.content for r in f.collect()] == ["one\ntwo"]
    none = spark.createDataFrame([], "path string, md5 string, task_id string, imported_at double")
    m = readers.record_import(f, none, "t", NOW).cache()
    assert readers.not_imported(f, m).count() == 0 and readers.not_imported(f, m, "none").count() == 1
    left, lost = readers.invalidate(m, spark.createDataFrame([("file:a.txt",), ("file:zz",)], "source string"))
    assert left.count() == 0 and [r.source for r in lost.collect()] == ["file:zz"]


def test_progress(spark):
    c = spark.createDataFrame([("t", "f", "completed", "", False), ("t", "g", "failed", "extracting", True), ("t", "g", "completed", "", False), ("t", "h", "failed", "reading", False)], "task_id string, file_id string, status string, failed_at string, retryable boolean")
    assert ingest.final_status(ingest.progress(c)).first().status == "completed_with_errors"
    assert {r.file_id: r.plan for r in ingest.retry_plan(c).collect()} == {"g": "chunk_retry", "h": "file_fallback"}


def test_snapshots_and_streams(spark, store, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/store")
    assert s.version() == 0 and s.read("paragraph").count() == 0
    assert s.commit(store, "first", 0) == 1
    with pytest.raises(RuntimeError):
        s.commit({}, expected=0)
    log = f"{tmp_path}/log"
    store["paragraph"].select("source").write.parquet(log)
    stream = spark.readStream.schema("source string").parquet(log)
    jobs.run(stream, jobs.rebuild_episodes(s, lambda: NOW), f"{tmp_path}/ck").awaitTermination()
    assert {r.source for r in s.read("episode").collect()} == {"s1", "s2"} and {r.status for r in s.read("rebuild_source").collect()} == {"done"}
    assert s.read("episode_paragraph").count() == 3 and s.read("paragraph", 1).count() == 3
    s.rollback(1)
    assert s.read("episode").count() == 0


def test_commits_never_change_a_version(spark, store, tmp_path):
    a, b = (Snapshots(spark, f"file://{tmp_path}/store") for _ in range(2))
    one = store["node"].limit(1)
    assert a.commit({"node": store["node"]}) == 1
    reader = b.store()
    assert a.commit({"node": one}) == 2 and a.commit({"edge": store["edge"]}) == 3
    assert reader["node"].count() == 3 and b.read("node").count() == 1  # what was opened stays readable
    assert b.rollback(1) == 4 and b.commit({"node": one.limit(0)}) == 5
    assert [b.read("node", v).count() for v in (1, 2, 3, 4, 5)] == [3, 1, 1, 3, 0] and b.read("edge", 4).count() == 0
    # Another commit comes in while tables are written.
    first = b._publish

    def late(*args):
        a.commit({"node": store["node"]})
        return first(*args)

    b._publish = late
    with pytest.raises(RuntimeError):
        b.commit({"node": one})
    assert b.version() == 6 and b.read("node").count() == 3
    # A manifest that was not written to its end is no version, and its number is passed over.
    a._create("manifests/00000007.json", '{"version": 7, "tab')
    assert a.version() == 6 and a.commit({"node": one}) == 8 and b.read("node").count() == 1


def test_repeated_changes_count_once(spark, store):
    h = store["paragraph"].select("hash")
    ch = h.withColumn("source", F.lit("a")).unionByName(h.withColumn("source", F.lit("b")))
    assert dml.patch(store["paragraph"], ch).count() == 3
    r = store["relation"].select("hash")
    states = [r.select("hash", F.lit(s).alias("state"), F.lit("e").alias("error"), F.lit(False).alias("bump")) for s in ("ready", "failed", "pending")]
    got = dml.set_vector_state(store["relation"], states[0].unionByName(states[1]).unionByName(states[2]), NOW)
    assert got.count() == 2 and {x.vector_state for x in got.collect()} == {"failed"}
    d = spark.createDataFrame([("ann", "bob", 1.0), ("ann", "bob", 2.0)], "src string, dst string, delta double")
    assert [x.weight for x in graph.shift_weights(store["edge"], d).where("src = 'ann'").collect()] == [4.0]


def test_delete_takes_vectors_and_edges(spark, store):
    v = store["paragraph"].select("hash", F.lit("paragraph").alias("item_type")).unionByName(store["relation"].select("hash", F.lit("relation").alias("item_type"))).withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>"))
    out = dml.delete_source(store | {"vector": v}, "s1")
    assert out["edge"].count() == 0 and out["relation"].count() == 0 and out["vector"].count() == 1
    kept, n = dml.delete_by_content(store | {"vector": v}, F.lit("Bob likes tea."))
    assert n == 1 and [(r.src, r.dst) for r in kept["edge"].collect()] == [("ann", "bob")] and kept["vector"].count() == 3


def brute_paths(edges, a, b, depth, most):
    near = {}
    for x, y in edges:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    found, now = [], [[a]]
    for _ in range(depth):
        now = [p + [y] for p in now for y in near.get(p[-1], ()) if y not in p]
        found += sorted(p for p in now if p[-1] == b)
        now = [p for p in now if p[-1] != b]
    return found[:most]


@settings(deadline=None, max_examples=6)
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=26), st.integers(1, 4), st.integers(1, 4))
def test_paths(spark, links, depth, most):
    """A hub (node 0) that all nodes know, at depths up to four."""
    edges = [(f"n{a}", f"n{b}") for a, b in links if a != b] + [("n0", f"n{b}") for b in range(1, 8)]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src string, dst string, weight double")
    pairs = spark.createDataFrame([(1, "n1", "n2"), (2, "n3", "n0"), (3, "n1", "n2"), (4, "n5", "n5"), (5, "n6", "zz")], "query_id int, a string, b string")
    got = {}
    for r in graph.paths(e, pairs, depth, most).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.nodes)
    for q, a, b in [(1, "n1", "n2"), (2, "n3", "n0"), (3, "n1", "n2")]:
        assert got.get(q, []) == brute_paths(edges, a, b, depth, most)
    assert not got.keys() & {4, 5}


def test_engine_branches(spark, store):
    """Relation questions, fallbacks, paths, persons and time in one engine."""
    none = F.lit(None).cast("array<float>")
    q = lambda *texts: spark.createDataFrame(list(enumerate(texts, 1)), "query_id int, text string").withColumn("embedding", none)
    e = Engine(store | {"vector": spark.createDataFrame([], TABLES["vector"])}, Config())
    assert {r.content for r in e.search(q("lik"), paths_on=False).collect()} >= {"Bob likes tea."}  # no word of the store: found by its n-grams
    walk = e.search(q("what links Ann and Tea")).where("result_type = 'path'").collect()
    assert [r.content for r in walk] == ["ann -> bob -> tea"] and walk[0]["rank"] == 1
    assert {r.content for r in e.search(q("Bob"), person="tea", paths_on=False).where("result_type = 'paragraph'").collect()} == {"Bob likes tea."}
    cards = e.query("entity", q(" BOB ", "nobody")).collect()
    assert [(r.query_id, r.neighbors, len(r.paragraphs)) for r in cards] == [(1, ["tea"], 2)]
    people = spark.createDataFrame([("p1", "Ann", "annie", None)], "person_id string, name string, nickname string, group_nicks string")
    got = e.query("person", q("ANNIE"), persons=people, now=NOW).collect()
    assert [(r.person_id, r.profile_text, r.stale) for r in got] == [("p1", None, True)]
    cjk = spark.createDataFrame([("c", "我们喜欢喝绿茶", False, 1.0)], "hash string, content string, is_deleted boolean, created_at double")
    hits = Engine({}, Config(sparse=replace(Config().sparse, tokenizer="char_ngram")))._sparse(cjk, q("绿茶"), 5, "paragraph_index")
    assert [r.hash for r in hits.collect()] == ["c"]


def test_stream_operators(spark, tmp_path):
    rows = [(f"k{i % 3}", i) for i in range(9)]
    spark.createDataFrame(rows, "request_key string, s int").selectExpr("request_key", "request_key as hash", "timestamp_seconds(s / 10) as ts").write.parquet(f"{tmp_path}/r")
    stream = spark.readStream.schema("request_key string, hash string, ts timestamp").parquet(f"{tmp_path}/r")
    for name, df, mode in (("once", jobs.single_flight(stream), "append"), ("tick", jobs.reinforce_buffer(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == 3


def test_profiles(spark, store):
    p = spark.createDataFrame([("p1", "Ann", "annie", '[{"group_nick_name": "Queen Ann"}]'), ("p2", "Bob", None, None)], "person_id string, name string, nickname string, group_nicks string")
    w = spark.createDataFrame([("p2",), ("ANNIE",), ("queen",), ("zz",)], "key string")
    assert {r.key: r.person_id for r in profile.resolve(p, w).collect()} == {"p2": "p2", "ANNIE": "p1", "queen": "p1"}
    al = profile.aliases(p)
    rel = profile.relation_evidence(al, store["relation"])
    hits = store["paragraph_entity"].join(store["entity"].where("lower(name) = 'ann'").select(F.col("hash").alias("entity_hash")), "entity_hash").select(F.lit("p1").alias("person_id"), F.col("paragraph_hash").alias("hash"), F.lit(0.9).alias("score"))
    built = profile.build(al, rel, profile.text_evidence(hits, store["paragraph"]), NOW)
    row = {r.person_id: r for r in built.collect()}
    assert row["p1"].relation_edges == ["Ann knows Bob"] and row["p1"].vector_evidence == ["Ann knows Bob."] and "Bob likes Tea" in row["p2"].profile_text
    snaps = dml.append_snapshots(dml.append_snapshots(spark.createDataFrame([], TABLES["profile_snapshot"]), built), built)
    assert {r.profile_version for r in profile.latest(snaps).collect()} == {2}
    assert profile.stale(snaps, NOW + 7 * 3600).count() == 2 and profile.stale(snaps, NOW).count() == 0
    o = spark.createDataFrame([("p1", "by hand", NOW, "", "")], TABLES["profile_override"])
    assert {r.person_id: r.overridden for r in profile.with_override(built, o).collect()} == {"p1": True, "p2": False}


def test_evaluation(spark, store):
    t = evaluate.sample_triples(store["relation"], 5)
    cases = evaluate.query_set(t)
    assert cases.count() == 8
    perfect = cases.select("query_id", F.col("expected_hashes")[0].alias("hash"), F.lit(1).alias("rank"))
    m = evaluate.metrics(cases, perfect).first().asDict()
    assert m["precision_at_1"] == m["mrr"] == m["spo_relation_hit_rate"] == 1.0 and m["empty_rate"] == 0.0
    cat = {r.category: (r.total, r.hit) for r in evaluate.by_category(cases, perfect).collect()}
    assert evaluate.objective(m, cat, "balanced") == pytest.approx(1.0) and evaluate.failures(cases, perfect).count() == 0
    best, score, history = evaluate.search_parameters({"a": [1, 2, 3], "b": [0, 5]}, lambda p: p["a"] + p["b"], 40)
    assert (best, score) == ({"a": 3, "b": 5}, 8) and len(history) == 41


def test_engine(spark, store):
    embed = readers.hashing_embedder(32)
    v = store["paragraph"].select("hash", F.lit("paragraph").alias("item_type"), embed(F.col("content")).alias("embedding"))
    v = v.unionByName(store["relation"].select("hash", F.lit("relation").alias("item_type"), embed(F.concat_ws(" ", "subject", "predicate", "object")).alias("embedding")))
    q = spark.createDataFrame([(1, "Bob likes tea"), (2, "Ann|knows|Bob")], "query_id int, text string").withColumn("embedding", embed(F.col("text")))
    e = Engine(store | {"vector": v}, Config())
    top = {r.query_id: r.content for r in e.search(q, paths_on=False).where("rank = 1").collect()}
    assert top[1] == "Bob likes tea." and "knows" in top[2]
    exact = e.relation_query(q).where("query_id = 2").collect()
    assert exact[0].score == 1.0 and len(exact) == 1
    assert e.query("time", q, lower=0.0, upper=NOW * 2).count() == 6
    assert e.query("aggregate", q, lower=0.0, upper=NOW * 2).count() > 0
    assert e.search(q, ppr=True).count() > 0


def test_recall_reads_only_edges_at_seeds(spark):
    """what is shuffled grows with the edges at the seeds, not with all."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def shuffled():
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    e = spark.range(20_000).selectExpr("concat('c', id) src", "concat('b', id % 50) dst", "1.0D weight", "array(sha2(string(id), 256)) relation_hashes")
    seeds = spark.createDataFrame([(1, "c7", 1), (1, "b7", 2), (2, "c8", 1), (2, "c58", 2), (3, "c9", 1)], "query_id int, canon string, rank int")
    before = shuffled()
    got = {(x.query_id, x.hash, x.candidate_type) for x in graph.recall(seeds, e).collect()}
    sha = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    assert got == {(1, sha(7), "direct_pair"), (2, sha(8), "two_hop_pair"), (2, sha(58), "two_hop_pair"), (3, sha(9), "one_hop_seed")}
    assert shuffled() - before < 10_000
