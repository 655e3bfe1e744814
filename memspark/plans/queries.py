"""The registered queries over the derived store, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import time as tm
from ..functions import vector as vx
from ..operators import aggregate, catalog, chunk, dml, episode, evaluate, fusion, graph, ivf, joins, knn, lifecycle, sparse, threshold
from ..sources import ingest, readers
from .engine import Engine, parse_relation_query
from .fixtures import NOW, T0, Fixtures
from .registry import ORACLES, QUERIES, R, query, r6  # noqa: F401

# Text, time and vectors.


@query("para", "SELECT doc_id, hash, word_count FROM para")
def text_normalize_hash(x: Fixtures):
    return x.para.select("doc_id", "hash", "word_count")


@query("names", "SELECT DISTINCT lower(trim(name)) AS canon, sha256(lower(trim(name))) AS hash, 'entity-' || sha256(lower(trim(name))) AS hash_key FROM names")
def text_canonical(x: Fixtures):
    h = tx.entity_hash(F.col("name"))
    return x.names.select(tx.canonical(F.col("name")).alias("canon"), h.alias("hash"), tx.hash_key(F.lit("entity"), h).alias("hash_key")).distinct()


@query("", "SELECT p_partkey, g AS gram, count(*) AS n FROM (SELECT p_partkey, unnest(list_transform(range(1, greatest(length(t), 2)), lambda i: substr(t, i::INT, 2))) AS g FROM (SELECT p_partkey, replace(lower(p_name), ' ', '') AS t FROM part)) GROUP BY ALL")
def text_char_ngrams(x: Fixtures):
    return x.table("part").select("p_partkey", F.explode(tx.char_ngrams(F.col("p_name"), 2)).alias("gram")).groupBy("p_partkey", "gram").agg(F.count(F.lit(1)).alias("n"))


@query("", r"""SELECT doc_id, CASE WHEN t = '' THEN 'mixed' WHEN len(parts) = 3 AND len(list_filter(parts, lambda p: trim(p) <> '')) = 3 THEN 'structured' WHEN len(ls) >= 5 AND list_sum(list_transform(ls, lambda l: length(l))) / len(ls)::DOUBLE < 20 THEN 'quote'
    WHEN regexp_matches(t, '(?s)["「『][^\n]*?["」』]') OR contains(substr(t, 1, 500), 'Chapter') OR contains(substr(t, 1, 500), 'CHAPTER') OR contains(substr(t, 1, 500), '###') THEN 'narrative' ELSE 'mixed' END AS knowledge_type
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t, string_split(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '|') AS parts, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l) <> '') AS ls FROM documents)""")
def type_detect(x: Fixtures):
    return x.documents.select("doc_id", tx.knowledge_type(F.col("text")).alias("knowledge_type"))


@query("", r"""SELECT doc_id, CASE WHEN len(ls) >= 5 AND list_sum(list_transform(ls, lambda l: length(l))) / len(ls)::DOUBLE < 20 THEN 'quote' ELSE 'narrative' END AS strategy, CASE WHEN len(ls) >= 5 AND list_sum(list_transform(ls, lambda l: length(l))) / len(ls)::DOUBLE < 20 THEN 400 ELSE 800 END AS chunk_size
    FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l) <> '') AS ls FROM documents)""")
def strategy_select(x: Fixtures):
    s = tx.import_strategy(F.col("text"))
    return x.documents.select("doc_id", s.alias("strategy"), tx.chunk_size(s).alias("chunk_size"))


@query("", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M') AS text, epoch(date_trunc('minute', ts))::DOUBLE AS back, (epoch(date_trunc('day', ts)) + 86340)::DOUBLE AS day_end FROM events")
def time_roundtrip(x: Fixtures):
    e = x.table("events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("s"))
    e = e.withColumn("text", tm.format_time(F.col("s")))
    return e.select("event_id", "text", tm.parse_query_time(F.col("text")).alias("back"), tm.parse_query_time(F.substring("text", 1, 10), True).alias("day_end"))


@query("para", "SELECT hash, coalesce(event_time_start, event_time, event_time_end, created_at) AS effective_start, coalesce(event_time_end, event_time, event_time_start, created_at) AS effective_end, CASE WHEN event_time_start IS NOT NULL THEN 'event_time_range' WHEN event_time IS NOT NULL THEN 'event_time' ELSE 'created_at_fallback' END AS match_basis FROM para")
def time_effective_interval(x: Fixtures):
    return x.para.select("hash", tm.effective_start().alias("effective_start"), tm.effective_end().alias("effective_end"), tm.match_basis().alias("match_basis"))


_LOW, _HIGH = T0 + 40 * 3600.0, T0 + 400 * 3600.0


@query("para", f"SELECT hash, coalesce(event_time_end, event_time, event_time_start, created_at) AS effective_end FROM para WHERE NOT is_deleted AND coalesce(event_time_end, event_time, event_time_start, created_at) >= {_LOW} AND coalesce(event_time_start, event_time, event_time_end, created_at) <= {_HIGH}")
def time_overlap_filter(x: Fixtures):
    return catalog.paragraphs_in_time(x.para, _LOW, _HIGH, limit=None).select("hash", "effective_end")


@query("para paragraph_relation", """SELECT relation_hash, paragraph_hash, effective_start, effective_end FROM (SELECT b.*, coalesce(event_time_start, event_time, event_time_end, created_at) AS effective_start, coalesce(event_time_end, event_time, event_time_start, created_at) AS effective_end,
    row_number() OVER (PARTITION BY relation_hash ORDER BY coalesce(event_time_end, event_time, event_time_start, created_at) DESC, paragraph_hash DESC) AS rn FROM paragraph_relation b JOIN para p ON p.hash = b.paragraph_hash) WHERE rn = 1""")
def time_best_support(x: Fixtures):
    return joins.best_support(x.paragraph_relation, x.para)


@query("", "SELECT vec_id, lo, hi, list_transform(embedding, lambda v: (round_even((v::DOUBLE - lo) / (hi - lo) * 255, 0) - 128)::INT) AS codes FROM (SELECT vec_id, embedding, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)")
def quantize_int8(x: Fixtures):
    return x.table("embeddings").select("vec_id", vx.quantize_int8(F.col("embedding")).alias("q")).select("vec_id", "q.lo", "q.hi", "q.codes")


@query("", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, len(embedding) = 64 AS valid FROM embeddings")
def vector_check(x: Fixtures):
    return x.table("embeddings").select("vec_id", F.round(vx.norm(F.col("embedding")), R).alias("norm"), vx.is_valid(F.col("embedding"), 64).alias("valid"))


@query("triples", "SELECT subject || '|' || predicate || '|' || object AS text, true AS structured, subject, predicate, object, CAST(NULL AS VARCHAR) AS error FROM triples")
def relation_query_parse(x: Fixtures):
    t = x.triples.select(F.concat_ws("|", "subject", "predicate", "object").alias("text"))
    return t.select("text", parse_relation_query(F.col("text")).alias("s")).select("text", "s.*")


@query("triples", "SELECT subject, predicate, object, count(*) AS n FROM triples GROUP BY ALL")
def relation_text_parse(x: Fixtures):
    t = x.triples.select(F.concat_ws(" -> ", "subject", "predicate", "object").alias("text"))
    return readers.relations_from(t).groupBy("subject", "predicate", "object").agg(F.count(F.lit(1)).alias("n"))


# Upserts and deletes.


@query("para", f"""SELECT hash, CASE WHEN hash < '8' THEN source ELSE 'in ' || source END AS source, CASE WHEN hash < '8' THEN created_at ELSE {NOW} END::DOUBLE AS created_at, CASE WHEN hash < '8' AND coalesce(source = 'src1', true) THEN is_deleted ELSE false END AS is_deleted FROM para WHERE hash < '8' OR source <> 'src1'""")
def dedup_paragraph_upsert(x: Fixtures):
    """Half of the paragraphs are there; all documents but those of one source come in: new ones by their first row, deleted ones live again."""
    existing = x.para.where("hash < '8'")
    shown = x.para.where("source != 'src1'").select("hash")
    d = x.documents.withColumn("hash", F.coalesce(tx.content_hash(tx.normalize(F.col("text"))), F.lit(""))).join(shown, "hash", "left_semi")
    incoming = d.select(F.col("text").alias("content"), F.concat(F.lit("in "), "source").alias("source"), F.col("doc_id").alias("ord"))
    return dml.upsert_paragraphs(existing, incoming, NOW).select("hash", "source", "created_at", "is_deleted")


@query("names entity", "SELECT hash, name, appearance_count * 2 AS appearance_count, false AS is_deleted FROM entity")
def entity_upsert_count(x: Fixtures):
    out = dml.merge_entities(x.entity, x.names.withColumn("ord", F.monotonically_increasing_id()), NOW)
    return out.select("hash", "name", "appearance_count", "is_deleted")


@query("relation", "SELECT hash, CASE WHEN hash[1] < '8' THEN round(confidence, 6) ELSE 1.0 END AS confidence FROM relation")
def relation_first_wins(x: Fixtures):
    existing = x.relation.where("substring(hash, 1, 1) < '8'")
    incoming = x.relation.select("subject", "predicate", "object").withColumns({"confidence": F.lit(1.0), "ord": F.lit(0)})
    return dml.insert_relations(existing, incoming).select("hash", r6("confidence"))


@query("paragraph_entity", "SELECT paragraph_hash, entity_hash, 2 * mention_count AS mention_count FROM paragraph_entity")
def mention_count_merge(x: Fixtures):
    return dml.link_mentions(x.paragraph_entity, x.paragraph_entity)


@query("relation para paragraph_relation", """WITH gone AS (SELECT hash FROM para WHERE source = 'src1'), touched AS (SELECT DISTINCT relation_hash FROM paragraph_relation WHERE paragraph_hash IN (SELECT hash FROM gone)),
    orphan AS (SELECT relation_hash FROM touched WHERE relation_hash NOT IN (SELECT relation_hash FROM paragraph_relation WHERE paragraph_hash NOT IN (SELECT hash FROM gone)))
    SELECT (SELECT count(*) FROM para WHERE source <> 'src1') AS paragraphs, (SELECT count(*) FROM relation WHERE hash NOT IN (SELECT relation_hash FROM orphan)) AS relations, (SELECT count(*) FROM paragraph_relation WHERE paragraph_hash NOT IN (SELECT hash FROM gone)) AS links""")
def delete_source_cascade(x: Fixtures):
    out, _ = dml.delete_paragraphs_deep(x.store, x.para.where("source = 'src1'"))
    n = lambda t, name: out[t].agg(F.count(F.lit(1)).alias(name))
    return n("paragraph", "paragraphs").crossJoin(n("relation", "relations")).crossJoin(n("paragraph_relation", "links"))


@query("para", "SELECT knowledge_type, count(*) AS n FROM (SELECT CASE WHEN knowledge_type = '' THEN 'repaired' ELSE knowledge_type END AS knowledge_type FROM para) GROUP BY 1")
def repair_types(x: Fixtures):
    fixed = dml.repair_types(x.para.withColumn("was", F.col("knowledge_type")))
    ok = F.col("knowledge_type").isin("structured", "narrative", "factual", "quote", "mixed")
    return fixed.select(F.when((F.col("was") == "") & ok, "repaired").otherwise(F.col("knowledge_type")).alias("knowledge_type")).groupBy("knowledge_type").agg(F.count(F.lit(1)).alias("n"))


@query("para", "SELECT hash, coalesce(event_time, CASE WHEN event_time_start IS NULL THEN created_at END) AS event_time FROM para")
def backfill_times(x: Fixtures):
    return dml.backfill_times(x.para).select("hash", "event_time")


# Listings and statistics.


@query("para", "SELECT source, count(*) AS n, max(created_at) AS last_created FROM para WHERE source <> '' GROUP BY source")
def catalog_sources(x: Fixtures):
    return catalog.sources(x.para)


@query("para", "SELECT coalesce(nullif(knowledge_type, ''), 'unknown') AS knowledge_type, count(*) AS n FROM para WHERE NOT is_deleted GROUP BY 1")
def catalog_type_distribution(x: Fixtures):
    return catalog.type_distribution(x.para)


@query("relation", "SELECT count(*) FILTER (coalesce(vector_state, 'none') = 'none') AS none, count(*) FILTER (vector_state = 'pending') AS pending, count(*) FILTER (vector_state = 'ready') AS ready, count(*) FILTER (vector_state = 'failed') AS failed, count(*) AS total FROM relation")
def catalog_vector_states(x: Fixtures):
    return catalog.vector_states(x.relation)


@query("relation", f"SELECT count(*) FILTER (NOT is_inactive) AS active, count(*) FILTER (is_inactive) AS inactive, count(*) FILTER (is_pinned) AS pinned, count(*) FILTER (protected_until > {NOW}) AS protected, count(*) AS total FROM relation")
def catalog_memory_status(x: Fixtures):
    return catalog.memory_status(x.relation, NOW)


@query("para entity relation", "SELECT (SELECT count(*) FROM para) AS paragraphs, (SELECT sum(word_count)::BIGINT FROM para) AS words, (SELECT count(*) FROM entity) AS entities, (SELECT count(*) FROM relation) AS relations")
def catalog_totals(x: Fixtures):
    return catalog.totals(x.para, x.entity, x.relation)


@query("relation", "SELECT count(*) AS n, max(created_at) AS last_created, max(hash) AS last_hash FROM relation")
def catalog_snapshot_key(x: Fixtures):
    return catalog.snapshot_key(x.relation)


@query("para", "SELECT count(*) AS every, count(*) FILTER (NOT is_deleted) AS live, count(*) FILTER (is_deleted) AS deleted FROM para")
def catalog_paragraph_counts(x: Fixtures):
    return catalog.paragraph_counts(x.para)


@query("rebuild_source", "SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM rebuild_source")
def catalog_rebuild_summary(x: Fixtures):
    return catalog.rebuild_summary(x.rebuild_source)


@query("relation", "SELECT hash FROM relation WHERE coalesce(vector_state, 'none') IN ('none', 'failed') AND vector_retry_count < 3 ORDER BY created_at, hash LIMIT 200")
def lookup_vector_backlog(x: Fixtures):
    return catalog.by_vector_state(x.relation, ["none", "failed"], 200, 3).select("hash")


@query("relation", "SELECT subject, predicate, object, hash FROM relation WHERE lower(predicate) = 'part_of'")
def lookup_relations(x: Fixtures):
    return catalog.triples(catalog.relations_by(x.relation, predicate="PART_OF"))


@query("relation", "SELECT hash FROM relation WHERE contains(lower(subject), 'asia') OR contains(lower(object), 'asia') ORDER BY hash LIMIT 5")
def lookup_relations_text(x: Fixtures):
    return catalog.relations_containing(x.relation, "Asia", 5).select("hash")


@query("relation", f"SELECT hash FROM relation WHERE is_pinned OR coalesce(protected_until > {NOW}, false)")
def lookup_protected(x: Fixtures):
    return catalog.protected(x.relation, NOW)


@query("deleted_relation entity", "SELECT hash, label, deleted_at, kind FROM (SELECT hash, subject || ' ' || predicate || ' ' || object AS label, deleted_at, 'relation' AS kind FROM deleted_relation UNION ALL SELECT hash, name, 1704067260.0, 'entity' FROM entity WHERE is_deleted) ORDER BY deleted_at DESC, hash LIMIT 50")
def catalog_recycle_bin(x: Fixtures):
    return catalog.recycle_bin(x.deleted_relation, x.entity)


# Joins.


@query("deleted_relation relation", "SELECT hash FROM deleted_relation WHERE hash NOT IN (SELECT hash FROM relation)")
def join_orphan_recycle(x: Fixtures):
    return joins.orphan_recycled(x.deleted_relation, x.relation)


@query("para paragraph_entity paragraph_relation", f"SELECT hash FROM para WHERE NOT is_deleted AND created_at < {T0 + 900 * 3600} AND hash NOT IN (SELECT paragraph_hash FROM paragraph_entity) AND hash NOT IN (SELECT paragraph_hash FROM paragraph_relation)")
def join_gc_paragraphs(x: Fixtures):
    return joins.paragraph_gc(x.para, x.paragraph_entity, x.paragraph_relation, T0 + 900 * 3600.0)


@query("entity edge para paragraph_entity", f"""SELECT hash, name FROM entity WHERE NOT is_deleted AND created_at < {NOW} AND lower(trim(name)) NOT IN (SELECT src FROM edge WHERE weight > 0 UNION SELECT dst FROM edge WHERE weight > 0)
    AND hash NOT IN (SELECT entity_hash FROM paragraph_entity JOIN para p ON p.hash = paragraph_hash WHERE NOT is_deleted)""")
def join_gc_entities(x: Fixtures):
    return joins.entity_gc(x.entity, graph.isolated(x.node, x.edge), x.paragraph_entity, x.para, NOW)


@query("entity para paragraph_entity", "SELECT hash FROM para WHERE hash IN (SELECT paragraph_hash FROM paragraph_entity WHERE entity_hash IN (SELECT hash FROM entity WHERE contains(lower(name), 'customer#00000001')))")
def join_person_semi(x: Fixtures):
    return catalog.of_person(x.para, x.paragraph_entity, x.entity, "Customer#00000001").select("hash")


@query("", "SELECT 'u' || user_id AS person_id, max(epoch(ts))::DOUBLE AS last_seen_at FROM events WHERE user_id % 3 = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def join_active_persons(x: Fixtures):
    e = x.table("events").select(F.col("event_type").alias("stream_id"), F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("u"), "user_id").alias("person_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("last_seen_at"))
    return joins.active_persons(e, e.select("stream_id", "user_id", (F.col("user_id").cast("int") % 3 == 0).alias("enabled")).distinct())


@query("entity paragraph_entity", "SELECT paragraph_hash, entity_hash, name, mention_count FROM paragraph_entity JOIN entity ON hash = entity_hash")
def join_bridge(x: Fixtures):
    return joins.entities_of(x.paragraph_entity, x.entity)


@query("episode episode_paragraph rebuild_source", "SELECT episode_id, source FROM episode WHERE source NOT IN (SELECT source FROM rebuild_source WHERE status <> 'done')")
def join_visible_episodes(x: Fixtures):
    return joins.visible_episodes(x.episode, x.rebuild_source).select("episode_id", "source")


@query("para paragraph_relation episode episode_paragraph", "SELECT 1 AS query_id, episode_id, count(DISTINCT b.relation_hash) AS relations, count(DISTINCT b.paragraph_hash) AS paragraphs FROM paragraph_relation b JOIN episode_paragraph e USING (paragraph_hash) WHERE b.relation_hash[1] = '7' GROUP BY episode_id")
def join_episode_relations(x: Fixtures):
    hits = x.paragraph_relation.where("substring(relation_hash, 1, 1) = '7'").select(F.lit(1).alias("query_id"), F.col("relation_hash").alias("hash")).distinct()
    return joins.episodes_of_relations(hits, x.paragraph_relation, x.episode_paragraph, x.episode).select("query_id", "episode_id", F.size("matched_relations").cast("bigint").alias("relations"), F.size("matched_paragraphs").cast("bigint").alias("paragraphs"))


@query("relation", """SELECT 'relation' AS kind, count(*) AS n, count(*) FILTER (hash[2] < '8') AS covered, 0::BIGINT AS orphan_vectors, count(*) FILTER (vector_state = 'ready' AND hash[2] >= '8') AS ready_but_missing, count(*) FILTER (coalesce(vector_state, 'ready') <> 'ready' AND hash[2] < '8') AS present_not_ready FROM relation""")
def audit_relation_vectors(x: Fixtures):
    v = x.relation.where("substring(hash, 2, 1) < '8'").select("hash", F.lit("relation").alias("item_type"))
    return joins.audit(v, x.para, x.entity, x.relation).where("kind = 'relation'")


# Recall.

_KNN = """SELECT query_id, hash, round(score, 6) AS score, rank FROM (SELECT q.query_id, v.hash, list_inner_product(v.u, q.u) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY list_inner_product(v.u, q.u) DESC, v.hash) AS rank FROM
    (SELECT hash, list_transform(e, lambda a: a / sqrt(list_inner_product(e, e))) AS u FROM (SELECT hash, embedding::DOUBLE[] AS e FROM vector WHERE {where})) v,
    (SELECT query_id, list_transform(e, lambda a: a / sqrt(list_inner_product(e, e))) AS u FROM (SELECT query_id, embedding::DOUBLE[] AS e FROM queries WHERE embedding IS NOT NULL)) q) WHERE rank <= {k}"""


@query("vector queries", _KNN.format(where="true", k=20))
def knn_top_k(x: Fixtures):
    return knn.search(x.vector, x.queries, 20).select("query_id", "hash", r6("score"), "rank")


@query("vector queries", _KNN.format(where="item_type = 'relation'", k=10))
def knn_filtered(x: Fixtures):
    return knn.search(x.vector, x.queries, 10, "relation").select("query_id", "hash", r6("score"), "rank")


@query()
def knn_ivf(x: Fixtures):
    """Every 100th row asks the index of all rows; the tests hold its recall against brute force."""
    return ivf.search(x.ivf, x.queries, 10).select("query_id", "hash", r6("score"), "rank")


_BM25 = r"""WITH doc AS ({docs}), w AS (SELECT hash, list_filter(string_split_regex(lower(content), '[^\pL\pN_]+'), lambda t: t <> '') AS ts FROM doc), st AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM w),
    p AS (SELECT hash, len(ts) AS dl, unnest(ts) AS term FROM w), tf AS (SELECT hash, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT query_id, unnest(list_filter(ts, lambda t, i: list_position(ts, t) = i)[1:64]) AS term FROM (SELECT query_id, list_filter(string_split_regex(lower(text), '[^\pL\pN_]+'), lambda t: t <> '') AS ts FROM {queries})),
    s AS (SELECT query_id, hash, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY query_id, hash)
    SELECT query_id, hash, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hash) AS rank FROM s) WHERE rank <= {k}"""


@query("para queries", _BM25.format(docs="SELECT hash, content FROM para", queries="queries", k=80))
def bm25_paragraphs(x: Fixtures):
    return sparse.bm25(x.para, x.queries, 80, index=x.posting).select("query_id", "hash", r6("score"))


@query("relation names", _BM25.format(docs="SELECT hash, subject || ' ' || predicate || ' ' || object AS content FROM relation", queries="(SELECT n_nationkey AS query_id, n_name || ' part_of' AS text FROM nation)", k=60))
def bm25_relations(x: Fixtures):
    q = x.table("nation").select(F.col("n_nationkey").alias("query_id"), F.concat("n_name", F.lit(" part_of")).alias("text"))
    return sparse.bm25(sparse.relation_docs(x.relation), q, 60).select("query_id", "hash", r6("score"))


@query("", """WITH q AS (SELECT r_regionkey AS query_id, unnest(list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i::INT, 2)))) AS term FROM (SELECT r_regionkey, replace(lower(r_name), ' ', '') AS t FROM region)), z AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
    g AS (SELECT DISTINCT 'p' || p_partkey AS hash, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i::INT, 2))) AS term FROM (SELECT p_partkey, replace(lower(p_name), ' ', '') AS t FROM part)),
    s AS (SELECT query_id, hash, count(*) / any_value(n)::DOUBLE AS score FROM q JOIN g USING (term) JOIN z USING (query_id) GROUP BY 1, 2) SELECT query_id, hash, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hash) AS rank FROM s) WHERE rank <= 20""")
def ngram_fallback(x: Fixtures):
    d = x.table("part").select(F.concat(F.lit("p"), "p_partkey").alias("hash"), F.col("p_name").alias("content"))
    return sparse.ngram_search(d, x.table("region").select(F.col("r_regionkey").alias("query_id"), F.col("r_name").alias("text"))).select("query_id", "hash", r6("score"))


@query("node", """SELECT c_custkey AS query_id, canon, 1::BIGINT AS n FROM (SELECT c_custkey, lower(c_name || ' of ' || n_name) AS t FROM customer JOIN nation ON c_nationkey = n_nationkey), node WHERE contains(t, canon) AND canon <> ''""")
def entity_mentions(x: Fixtures):
    c, n = x.table("customer"), x.table("nation")
    q = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("query_id"), F.concat("c_name", F.lit(" of "), "n_name").alias("text"))
    return graph.mentions(q, x.node)


# Fusion and thresholds.


@query("dense", "SELECT query_id, hash, round(CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6)::DOUBLE AS score FROM dense WINDOW w AS (PARTITION BY query_id)")
def fuse_minmax(x: Fixtures):
    return fusion.minmax(x.dense).select("query_id", "hash", r6("score"))


_RRF = """r AS (SELECT query_id, hash, 0.7 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hash)) AS f FROM dense UNION ALL SELECT query_id, hash, 0.3 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hash)) FROM words),
    fused AS (SELECT query_id, hash, sum(f)::DOUBLE AS score FROM r GROUP BY 1, 2)"""


@query("dense words", f"WITH {_RRF} SELECT query_id, hash, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6)::DOUBLE AS score FROM fused WINDOW w AS (PARTITION BY query_id)")
def fuse_rrf(x: Fixtures):
    return fusion.rrf([(x.dense, 0.7), (x.words, 0.3)]).select("query_id", "hash", r6("score"))


@query("dense words", "SELECT query_id, hash, round(max(score), 6) AS score, CASE WHEN count(*) > 1 THEN 'relation_fusion' ELSE 'relation_' || min(s) END AS source FROM (SELECT *, 'dense' AS s FROM dense UNION ALL SELECT *, 'sparse' FROM words) GROUP BY 1, 2")
def merge_relations_max(x: Fixtures):
    return fusion.merge_max(x.dense, x.words).select("query_id", "hash", r6("score"), "source")


@query("dense words", """WITH a AS (SELECT query_id, hash, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS v FROM dense WINDOW w AS (PARTITION BY query_id)), b AS (SELECT query_id, hash, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS s FROM words WINDOW w AS (PARTITION BY query_id))
    SELECT query_id, hash, round(0.6 * greatest(coalesce(v, 0), coalesce(s, 0)) + 0.3 * CASE WHEN s IS NULL THEN 0 WHEN hash LIKE '%1' THEN 1.0 WHEN hash LIKE '%2' THEN 0.75 ELSE 0.55 END + 0.1 * CASE WHEN s IS NULL THEN 0 ELSE 2 / 3.0 END, 6)::DOUBLE AS score FROM a FULL JOIN b USING (query_id, hash)""")
def merge_relations_graph(x: Fixtures):
    kind = F.when(F.col("hash").endswith("1"), "direct_pair").when(F.col("hash").endswith("2"), "one_hop_seed").otherwise("two_hop_pair")
    g = x.words.select("query_id", "hash", kind.alias("candidate_type"), F.lit(2).alias("support"))
    return fusion.merge_graph(x.dense, x.words, g).select("query_id", "hash", r6("score"))


@query("dense words", """WITH r AS (SELECT query_id, 'r' || hash AS hash, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'r' || hash) AS n FROM words), u AS (SELECT query_id, hash, score * 0.4 AS score, 'paragraph' AS result_type, false AS safe FROM dense UNION ALL SELECT query_id, hash, score * (1 - 0.4), 'relation', n <= 2 FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, result_type, hash) AS rk FROM u) SELECT query_id, hash, round(score, 6) AS score, result_type, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS rank FROM k
    WHERE result_type = 'paragraph' OR safe OR NOT EXISTS (SELECT 1 FROM k p WHERE p.query_id = k.query_id AND p.result_type = 'paragraph' AND 'r' || p.hash = k.hash AND p.rk < k.rk)""")
def fuse_alpha_dedup(x: Fixtures):
    rel = x.words.withColumn("hash", F.concat(F.lit("r"), "hash"))
    bridge = x.dense.select(F.col("hash").alias("paragraph_hash"), F.concat(F.lit("r"), "hash").alias("relation_hash")).distinct()
    return fusion.fuse(x.dense, rel, bridge, 0.4, 2).select("query_id", "hash", r6("score"), "result_type", "rank")


@query("dense", "SELECT query_id, hash, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 1) DESC, CASE WHEN hash LIKE '%5' THEN NULL ELSE length(hash) END DESC NULLS LAST, hash) AS rank FROM dense")
def temporal_sort(x: Fixtures):
    when = F.when(~F.col("hash").endswith("5"), F.length("hash").cast("double"))
    d = x.dense.select("query_id", "hash", F.round("score", 1).alias("score"), when.alias("effective_end"), F.lit(None).cast("double").alias("effective_start"))
    return fusion.temporal_sort(d).select("query_id", "hash", "rank")


_THRESHOLD = """d AS (SELECT query_id, score, lag(score) OVER w - score AS dp, row_number() OVER w AS r FROM dense WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, hash)),
    g AS (SELECT query_id, score AS by_gap FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dp, r) AS k FROM d WHERE dp IS NOT NULL) WHERE k = 1),
    t AS (SELECT query_id, quantile_cont(score, 0.75) AS by_percentile, avg(score) - 1.5 * stddev_pop(score) AS by_deviation, any_value(by_gap) AS by_gap FROM dense JOIN g USING (query_id) GROUP BY query_id),
    m AS (SELECT *, least(greatest(list_sort([by_percentile, by_deviation, by_gap])[2], 0.3), 0.95) AS threshold FROM t)"""


@query("dense", f"WITH {_THRESHOLD} SELECT query_id, round(by_percentile, 6) AS by_percentile, round(by_deviation, 6) AS by_deviation, round(by_gap, 6) AS by_gap, round(threshold, 6)::DOUBLE AS threshold FROM m")
def threshold_parts(x: Fixtures):
    return threshold.thresholds(x.dense).select("query_id", *[r6(c) for c in ("by_percentile", "by_deviation", "by_gap", "threshold")])


@query("dense", f"WITH {_THRESHOLD}, j AS (SELECT dense.*, threshold, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hash) AS n, sum(CASE WHEN score >= threshold THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS e FROM dense JOIN m USING (query_id)) SELECT query_id, hash FROM j WHERE CASE WHEN e >= 3 THEN score >= threshold ELSE n <= 3 END")
def threshold_adaptive(x: Fixtures):
    return threshold.adaptive(x.dense).select("query_id", "hash")


@query("dense", "SELECT query_id, hash FROM dense WHERE CASE WHEN hash LIKE '%3' THEN 0.8 ELSE score END >= 0.2")
def filter_confidence(x: Fixtures):
    r = x.dense.withColumns({"result_type": F.when(F.col("hash").endswith("3"), "relation").otherwise("paragraph"), "confidence": F.lit(0.8)})
    return threshold.by_confidence(r, 0.2).select("query_id", "hash")


@query("dense", "WITH o AS (SELECT *, row_number() OVER (PARTITION BY query_id, substr(hash, 1, 3) ORDER BY score DESC, hash) AS n FROM dense) SELECT query_id, hash, rank FROM (SELECT query_id, hash, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hash) AS rank FROM o WHERE n = 1) WHERE rank <= 10")
def filter_diversity(x: Fixtures):
    return threshold.diverse(x.dense, 10, 3).select("query_id", "hash", "rank")


@query("dense words", """WITH b AS (SELECT query_id, 'paragraph:' || hash AS key, 1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hash)) AS p, 'search' AS s FROM dense UNION ALL SELECT query_id, 'paragraph:' || hash, 0.5 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hash)), 'time' FROM words),
    g AS (SELECT query_id, key, sum(p)::DOUBLE AS score, list_sort(list(DISTINCT s)) AS source_branches FROM b GROUP BY 1, 2) SELECT query_id, key, round(score, 6) AS score, source_branches, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM g) WHERE rank <= 5""")
def aggregate_mix(x: Fixtures):
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "hash")
    row = lambda df: df.select("query_id", "hash", F.lit("paragraph").alias("result_type"), F.row_number().over(w).alias("rank"))
    return aggregate.mix({"search": row(x.dense), "time": row(x.words)}, {"time": 0.5}).select("query_id", "key", r6("score"), "source_branches", "rank")


# Graph.


@query("relation", "SELECT lower(subject) AS src, lower(object) AS dst, round(sum(confidence), 6) AS weight, count(*) AS n FROM relation GROUP BY 1, 2")
def graph_edge_sum(x: Fixtures):
    p = x.relation.select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("confidence").alias("weight"), "hash", F.lit(0).alias("ord"))
    return graph.build_edges(p).select("src", "dst", r6("weight"), F.size("relation_hashes").cast("bigint").alias("n"))


@query("edge", "SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edge UNION ALL SELECT dst, 0, 1 FROM edge) GROUP BY node")
def graph_degree(x: Fixtures):
    return graph.degrees(x.edge)


@query("node edge", "SELECT canon, name FROM node WHERE canon NOT IN (SELECT src FROM edge WHERE weight > 0 UNION SELECT dst FROM edge WHERE weight > 0)")
def graph_isolated(x: Fixtures):
    return graph.isolated(x.node, x.edge)


@query("edge", "SELECT src AS node, round(weight, 6) AS weight FROM edge WHERE dst = 'brand#11'")
def graph_neighbors(x: Fixtures):
    return graph.neighbors(x.edge, "Brand#11", incoming=True).select("node", r6("weight"))


@query("edge", "SELECT src, dst, round(weight * 0.5, 6) AS weight FROM edge WHERE weight * 0.5 > 0 AND weight * 0.5 < 0.1")
def graph_low_weight(x: Fixtures):
    return graph.low_weight(graph.decay(x.edge, 0.5), 0.1).select("src", "dst", r6("weight"))


@query("edge", "SELECT src, dst, round(least(greatest(weight - 0.25, 0.1), 10), 6)::DOUBLE AS weight FROM edge")
def graph_shift(x: Fixtures):
    return graph.shift_weights(x.edge, x.edge.select("src", "dst", F.lit(-0.25).alias("delta"))).select("src", "dst", r6("weight"))


@query("node edge", "SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM edge) AS edges, round((SELECT count(*) FROM edge) / ((SELECT count(*) FROM node)::DOUBLE * ((SELECT count(*) FROM node) - 1)), 9) AS density")
def graph_counts(x: Fixtures):
    return graph.counts(x.node, x.edge).select("nodes", "edges", F.round("density", 9).alias("density"))


@query("relation edge", "SELECT canon, src, dst, hash, n FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY src, dst, hash) AS n FROM (SELECT lower(n_name) AS canon FROM nation) JOIN (SELECT src AS canon, src, dst, unnest(relation_hashes) AS hash FROM edge UNION ALL SELECT dst, src, dst, unnest(relation_hashes) FROM edge WHERE src <> dst) USING (canon))")
def graph_incident(x: Fixtures):
    return graph.incident(x.edge, x.table("nation").select(F.lower("n_name").alias("canon"))).select("canon", "src", "dst", "hash", "n")


@query("relation edge", "SELECT src, dst, CASE WHEN len(list_filter(relation_hashes, lambda h: h[1] <> 'a')) = 0 THEN 0 ELSE round(weight, 6) END::DOUBLE AS weight, len(list_filter(relation_hashes, lambda h: h[1] <> 'a')) AS n FROM edge")
def graph_prune(x: Fixtures):
    ops = x.edge.select("src", "dst", F.explode("relation_hashes").alias("hash")).where("substring(hash, 1, 1) = 'a'")
    return graph.prune_hashes(x.edge, ops).select("src", "dst", r6("weight"), F.size("relation_hashes").cast("bigint").alias("n"))


def _rank_sql(rounds: int, seed: str) -> str:
    parts = [f"s0 AS ({seed})", "o AS (SELECT src, sum(weight) AS t FROM edge WHERE weight > 0 GROUP BY src)", "p AS (SELECT src, dst, weight / t AS p FROM edge JOIN o USING (src))", "r0 AS (SELECT node, seed AS score FROM s0)"]
    for i in range(1, rounds + 1):
        parts.append(f"f{i} AS (SELECT dst AS node, 0.85 * sum(score * p) AS score FROM r{i - 1} JOIN p ON node = src GROUP BY dst)")
        parts.append(f"r{i} AS (SELECT node, sum(score) AS score FROM (SELECT * FROM f{i} UNION ALL SELECT node, seed * (1 - (SELECT coalesce(sum(score), 0) FROM f{i})) FROM s0) GROUP BY node)")
    return "WITH " + ", ".join(parts) + f" SELECT node, round(score, 9) AS score FROM r{rounds}"


@query("node edge", _rank_sql(10, "SELECT canon AS node, 1.0::DOUBLE / (SELECT count(*) FROM node) AS seed FROM node"))
def graph_pagerank_10(x: Fixtures):
    return graph.pagerank(x.edge, x.node, iterations=10, tol=0.0).select("node", F.round("score", 9).alias("score"))


@query("node edge", _rank_sql(5, "SELECT lower(r_name) AS node, 0.2::DOUBLE AS seed FROM region").replace("SELECT node, round(score, 9)", "SELECT 'all' AS query_id, node, round(score, 9)"))
def graph_ppr_5(x: Fixtures):
    reversed_ = x.edge.select("src", "dst", "weight", "relation_hashes")
    seeds = x.table("region").select(F.lit("all").alias("query_id"), F.col("r_name").alias("node"), F.lit(1.0).alias("weight"))
    return graph.pagerank(reversed_, x.node, seeds, iterations=5, tol=0.0).select("query_id", "node", F.round("score", 9).alias("score"))


_U = "u AS (SELECT DISTINCT * FROM (SELECT src AS x, dst AS y FROM g UNION ALL SELECT dst, src FROM g))"


@query("relation", f"""WITH g AS (SELECT DISTINCT lower(subject) AS src, lower(object) AS dst FROM relation), {_U}, pr AS (SELECT DISTINCT a, b FROM (SELECT lower(n_name) AS a, lower(p_brand) AS b FROM part JOIN nation ON n_nationkey = p_partkey % 25 UNION ALL SELECT lower(s_name), lower(r_name) FROM supplier JOIN region ON r_regionkey = s_suppkey % 5
    UNION ALL SELECT lower(r_name), lower(p_brand) FROM region, part)), w AS (SELECT a, b, [a, b] AS nodes FROM pr JOIN u ON x = a AND y = b UNION ALL SELECT a, b, [a, p2.y, b] FROM pr JOIN u p2 ON p2.x = a JOIN u p3 ON p3.x = p2.y AND p3.y = b WHERE p2.y NOT IN (a, b)
    UNION ALL SELECT a, b, [a, p2.y, p3.y, b] FROM pr JOIN u p2 ON p2.x = a JOIN u p3 ON p3.x = p2.y JOIN u p4 ON p4.x = p3.y AND p4.y = b WHERE p2.y NOT IN (a, b) AND p3.y NOT IN (a, b, p2.y))
    SELECT a, b, nodes, rank FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY len(nodes), array_to_string(nodes, chr(0))) AS rank FROM w) WHERE rank <= 5""")
def graph_paths_3(x: Fixtures):
    """Over all edges, hubs too: from nations to brands, suppliers to regions, regions to brands."""
    e = x.relation.select(F.lower("subject").alias("src"), F.lower("object").alias("dst"), F.lit(1.0).alias("weight")).distinct()
    s, r, n, p = x.table("supplier"), x.table("region"), x.table("nation"), x.table("part")
    pair = lambda df, a, b: df.select(F.lower(a).alias("a"), F.lower(b).alias("b"))
    brands = p.select("p_brand").distinct()  # a fixed list
    pairs = pair(p.join(n, F.col("n_nationkey") == F.col("p_partkey") % 25), "n_name", "p_brand").union(pair(s.join(r, F.col("r_regionkey") == F.col("s_suppkey") % 5), "s_name", "r_name")).union(pair(r.crossJoin(F.broadcast(brands)), "r_name", "p_brand"))
    return graph.paths(e, pairs.distinct().withColumn("query_id", F.concat_ws("|", "a", "b"))).select("a", "b", "nodes", "rank")


@query("relation edge", """WITH h AS (SELECT src, dst, unnest(relation_hashes) AS hash FROM edge) SELECT n_nationkey AS query_id, hash, 'one_hop_seed' AS candidate_type, rank FROM (SELECT n_nationkey, hash, row_number() OVER (PARTITION BY n_nationkey ORDER BY hash) AS rank FROM (SELECT DISTINCT n_nationkey, hash FROM nation JOIN h ON src = lower(n_name) OR dst = lower(n_name))) WHERE rank <= 24""")
def graph_recall_seed(x: Fixtures):
    seeds = x.table("nation").select(F.col("n_nationkey").alias("query_id"), F.lower("n_name").alias("canon"), F.lit(1).alias("rank"))
    return graph.recall(seeds, x.edge).select("query_id", "hash", "candidate_type", "rank")


@query("relation edge", """WITH h AS (SELECT src, dst, unnest(relation_hashes) AS hash FROM edge), u AS (SELECT src AS p, dst AS q, hash FROM h UNION SELECT dst, src, hash FROM h), s AS (SELECT s_suppkey AS query_id, lower(s_name) AS a, lower(r_name) AS b FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
    two AS (SELECT DISTINCT query_id, unnest([x.hash, y.hash]) AS hash FROM s JOIN u x ON x.p = a JOIN u y ON y.p = x.q AND y.q = b) SELECT query_id, hash, 'two_hop_pair' AS candidate_type, row_number() OVER (PARTITION BY query_id ORDER BY hash) AS rank FROM two""")
def graph_recall_pair(x: Fixtures):
    s, n, r = x.table("supplier"), x.table("nation"), x.table("region")
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    seeds = j.select(F.col("s_suppkey").alias("query_id"), F.inline(F.array(F.struct(F.lit(1).alias("rank"), F.lower("s_name").alias("canon")), F.struct(F.lit(2).alias("rank"), F.lower("r_name").alias("canon")))))
    return graph.recall(seeds, x.edge).select("query_id", "hash", "candidate_type", "rank")


# Episodes.


@query("", "SELECT event_type, user_id, group_no, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(k) OVER (PARTITION BY event_type, user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS group_no FROM (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY event_type, user_id ORDER BY ts) > 86400 THEN 1 ELSE 0 END AS k FROM events)) GROUP BY 1, 2, 3")
def episode_gap_groups(x: Fixtures):
    e = x.table("events").withColumns({"key": F.concat_ws("/", "event_type", "user_id"), "at": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6})
    g = episode.group_by_gap(e, "key", "at", 86400)
    return g.groupBy("event_type", "user_id", "group_no").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query()
def episode_groups(x: Fixtures):
    return episode.group(x.para)


@query()
def episode_fallback(x: Fixtures):
    g = x.para.join(episode.group(x.para).select("hash", "anchor", "group_no"), "hash")
    return episode.fallback(g, x.paragraph_entity, x.entity, NOW)


@query("para", "SELECT source, 0 AS group_no, min(coalesce(event_time_start, event_time, event_time_end, created_at)) AS event_time_start, max(coalesce(event_time_end, event_time, event_time_start, created_at)) AS event_time_end, CASE WHEN bool_or(time_granularity = 'minute') THEN 'minute' ELSE 'day' END AS time_granularity, 1.0::DOUBLE AS time_confidence FROM para GROUP BY source")
def episode_time_meta(x: Fixtures):
    return episode.time_meta(x.para.withColumn("group_no", F.lit(0)))


@query("para", """WITH t AS (SELECT source, doc_id, i, tok FROM (SELECT source, doc_id, unnest(ts) AS tok, generate_subscripts(ts, 1) AS i FROM (SELECT source, doc_id, regexp_extract_all(lower(content), '[A-Za-z0-9_\\x{4e00}-\\x{9fff}]{2,}') AS ts FROM para))
    WHERE tok NOT IN ('the','and','that','this','with','from','for','have','will','your','you')), c AS (SELECT source, tok AS token, count(*) AS n, min(doc_id * 1000000 + i) AS f FROM t GROUP BY 1, 2) SELECT source, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f, token) AS rank FROM c) WHERE rank <= 12""".replace("\\\\x", "\\x"))
def episode_keywords(x: Fixtures):
    g = x.para.select("source", F.lit(0).alias("group_no"), "content", F.col("doc_id").alias("ord"))
    return episode.keywords(g).select("source", "token", "n", "rank")


@query("episode", """WITH q AS (SELECT DISTINCT source AS query_id, lower(source) AS t FROM documents), s AS (SELECT query_id, episode_id, event_time_end, updated_at, (4 * contains(lower(title), t)::INT + 3 * contains('notes src1', t)::INT + 2 * contains(lower(summary), t)::INT + contains('ann ' || lower(source), t)::INT)::DOUBLE AS score FROM episode, q)
    SELECT query_id, episode_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_time_end DESC, updated_at DESC, episode_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20""")
def episode_lexical(x: Fixtures):
    q = x.table("documents").select(F.col("source").alias("query_id"), F.col("source").alias("text")).distinct()
    return episode.lexical(x.episode, q)


@query("rebuild_source", f"SELECT source, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'pending' ELSE status END AS status, CASE WHEN source IN ('src1', 'src2', 'src3') THEN {NOW} ELSE {T0} END::DOUBLE AS requested_at FROM rebuild_source")
def episode_enqueue(x: Fixtures):
    s = x.table("documents").where("source in ('src1', 'src2', 'src3')").select("source")
    return episode.enqueue(x.rebuild_source, s, NOW, "test").select("source", "status", "requested_at")


# Lifecycle.


@query("relation edge", f"""WITH due AS (SELECT * FROM relation WHERE hash[6] = '0' AND (last_reinforced IS NULL OR last_reinforced + 3600 <= {NOW})), g AS (SELECT lower(subject) AS src, lower(object) AS dst, sum(1 - confidence / 10.0) AS d FROM due GROUP BY 1, 2)
    SELECT src, dst, round(CASE WHEN d IS NULL THEN weight ELSE least(greatest(weight + d, 0.1), 10) END, 6)::DOUBLE AS weight FROM edge LEFT JOIN g USING (src, dst)""")
def life_reinforce(x: Fixtures):
    out = lifecycle.reinforce(x.store, x.relation.where("substring(hash, 6, 1) = '0'"), NOW)
    return out["edge"].select("src", "dst", r6("weight"))


@query("relation edge", f"""WITH h AS (SELECT src, dst, unnest(relation_hashes) AS hash FROM edge WHERE weight > 0 AND weight < 0.25), s AS (SELECT src, dst, bool_or(coalesce(is_pinned, false) OR coalesce(protected_until > {NOW}, false)) AS safe FROM h JOIN relation USING (hash) GROUP BY 1, 2)
    SELECT hash, is_inactive OR hash IN (SELECT hash FROM h JOIN s USING (src, dst) WHERE NOT safe) AS is_inactive, CASE WHEN is_inactive THEN inactive_since WHEN hash IN (SELECT hash FROM h JOIN s USING (src, dst) WHERE NOT safe) THEN {NOW}::DOUBLE END AS inactive_since FROM relation""")
def life_freeze(x: Fixtures):
    from ..config import Memory

    return lifecycle.freeze(x.store, NOW, Memory(prune_below=0.25))["relation"].select("hash", "is_inactive", "inactive_since")


@query("relation deleted_relation", f"""WITH g AS (SELECT hash FROM relation WHERE is_inactive AND inactive_since < {NOW} - 86400) SELECT 'live' AS place, hash FROM relation WHERE hash NOT IN (SELECT hash FROM g) UNION ALL SELECT 'bin', hash FROM deleted_relation WHERE hash NOT IN (SELECT hash FROM g) UNION ALL SELECT 'bin', hash FROM g""")
def life_prune_to_bin(x: Fixtures):
    out = lifecycle.prune(x.store, NOW)
    rows = lambda t, name: out[t].select(F.lit(name).alias("place"), "hash")
    return rows("relation", "live").unionByName(rows("deleted_relation", "bin"))


@query("relation deleted_relation", "SELECT hash, subject, predicate, object FROM relation UNION SELECT hash, subject, predicate, object FROM deleted_relation WHERE hash[1] = 'x'")
def life_restore(x: Fixtures):
    return lifecycle.restore_memory(x.store, x.deleted_relation)["relation"].select("hash", "subject", "predicate", "object")


@query("relation", "SELECT alias, min(hash) AS hash FROM (SELECT hash[1:4] AS alias, hash FROM relation) GROUP BY alias HAVING count(DISTINCT hash) = 1")
def life_alias_map(x: Fixtures):
    return dml.hash_aliases(x.relation, 4)[0]


@query("relation", f"SELECT hash, hash[7] = '0' OR is_pinned AS is_pinned, CASE WHEN hash[7] = '0' THEN NULL ELSE protected_until END AS protected_until FROM relation")
def life_protect(x: Fixtures):
    return lifecycle.protect(x.relation, x.relation.where("substring(hash, 7, 1) = '0'"), NOW, 0).select("hash", "is_pinned", "protected_until")


# Sources, chunks, evaluation.


@query("", "SELECT conv_id::VARCHAR AS stream_id, min(turn)::DOUBLE AS event_time_start, max(turn)::DOUBLE AS event_time_end, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS k FROM conversations) WHERE k <= 5 GROUP BY conv_id")
def stream_summaries(x: Fixtures):
    m = x.table("conversations").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").cast("double").alias("at"), "text")
    return ingest.summarize_streams(m, 5).drop("transcript")


@query("", "SELECT chat_id, count(*) AS n FROM (SELECT DISTINCT conv_id, 'c' || (conv_id % 7) AS chat_id FROM conversations) GROUP BY chat_id ORDER BY n DESC, chat_id LIMIT 30")
def migration_preview(x: Fixtures):
    return readers.chat_counts(x.chat.where(readers.selection(id_from=0)))


@query()
def chat_history_map(x: Fixtures):
    return ingest.map_chats(x.chat)["items"]


@query()
def chunk_documents(x: Fixtures):
    d = x.table("documents").select("doc_id", F.col("text").alias("content"), tx.import_strategy(F.col("text")).alias("strategy"))
    return chunk.rescue(chunk.split(d)).select("doc_id", "strategy", "idx", "start", "end", "title", F.md5("text").alias("md5"))


@query("dense", """WITH r AS (SELECT query_id, hash, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hash) AS rank FROM dense), c AS (SELECT query_id, max(hash) AS h FROM dense GROUP BY 1), p AS (SELECT c.query_id, min(r.rank) FILTER (r.rank <= 20) AS rank FROM c LEFT JOIN r ON r.query_id = c.query_id AND r.hash = c.h GROUP BY 1)
    SELECT count(*) AS total, round(avg(coalesce(rank <= 1, false)::INT), 6) AS precision_at_1, round(avg(coalesce(rank <= 3, false)::INT), 6) AS precision_at_3, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(coalesce(rank <= 20, false)::INT), 6) AS recall_at_k, 0.0::DOUBLE AS empty_rate FROM p""")
def eval_ir_metrics(x: Fixtures):
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "hash")
    cases = x.dense.groupBy("query_id").agg(F.array(F.max("hash")).alias("expected_hashes")).withColumn("category", F.lit("query_nl"))
    m = evaluate.metrics(cases, x.dense.withColumn("rank", F.row_number().over(w)), 20)
    return m.select("total", r6("precision_at_1"), r6("precision_at_3"), r6("mrr"), r6("recall_at_k"), r6("empty_rate"))


@query()
def eval_query_set(x: Fixtures):
    return evaluate.query_set(evaluate.sample_triples(x.relation, 24))


@query()
def hybrid_search(x: Fixtures):
    """The flagship: dense, sparse and graph recall fused, thresholded, deduplicated."""
    v = x.vector.select(F.col("hash").alias("v"), "item_type", "embedding").withColumn("doc_id", F.expr("cast(substring(v, 2) as bigint)"))
    vectors = v.where("item_type = 'paragraph'").join(x.para.select("hash", "doc_id"), "doc_id").select("hash", "item_type", "embedding")
    # A relation's vector belongs to where the customer of that number is.
    c = x.table("customer").select(F.col("c_name").alias("subject"), F.col("c_custkey").alias("doc_id"))
    r = x.relation.where("predicate = 'located_in'").join(c, "subject").select("hash", "doc_id")
    vectors = vectors.unionByName(v.where("item_type = 'relation'").join(r, "doc_id").select("hash", "item_type", "embedding"))
    # Negative ids: questions for a nation's relation, without an embedding.
    n = x.table("nation").join(x.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    asked = n.select((-1 - F.col("n_nationkey")).cast("bigint").alias("query_id"), F.concat_ws("|", "n_name", F.lit("part_of"), "r_name").alias("text"), F.lit(None).cast("array<float>").alias("embedding"))
    store = x.store | {"vector": x.stored("search_vector", lambda: vectors), "paragraph_index": x.posting, "relation_index": x.relation_posting}
    found = Engine(store).search(x.stored("search_query", lambda: x.queries.unionByName(asked)))
    return found.select("query_id", "hash", r6("score"), "result_type", "rank", "source")


from . import index_queries, store_queries  # noqa: E402, F401  registers the rest
