"""Store tables derived from the benchmark tables, in Spark and as DuckDB SQL, for the registered queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ivf, sparse
from ..sources.snapshot import Tables, cut, exists, settle, write

T0 = 1_704_067_200
NOW = T0 + 2_000_000.0


class Fixtures:
    """Each table of the store as a frame over the files in sf_dir; nothing is read before it is used.

    What stands for a table of a real store is written once for each application and folder, and read by all queries
    after; the files in sf_dir must not change meanwhile.
    """

    _written: dict[tuple[str, str, str], tuple[DataFrame, str]] = {}
    _indexes: dict[tuple[str, str, str], ivf.Index] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = settle(spark), sf_dir

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir.rstrip("/"), name)
        if key not in self._written or not exists(self.spark, self._written[key][1]):
            self._written[key] = write(build())
        return self._written[key][0]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        """Documents; texts that lie in fewer splits than there are cores are dealt to all tasks."""
        d = self.table("documents")
        return d.repartition("doc_id") if d.rdd.getNumPartitions() < self.spark.sparkContext.defaultParallelism else d

    @cached_property
    def para(self) -> DataFrame:
        return self.stored("paragraph", self._para)

    def _para(self) -> DataFrame:
        d, i = self.documents, F.col("doc_id")
        created = (F.lit(T0) + i * 3600).cast("double")
        p = d.select("doc_id", "source", tx.normalize(F.col("text")).alias("content"), created.alias("created_at"))
        timed = i % 3 == 0
        p = p.select(
            # Never null: else a join on it would have its whole computation as a filter below, in the scan.
            F.coalesce(tx.content_hash(F.col("content")), F.lit("")).alias("hash"), "content", "source", "doc_id", tx.word_count(F.col("content")).alias("word_count"), "created_at", F.col("created_at").alias("updated_at"),
            F.when(~timed & (i % 5 != 0), F.col("created_at")).alias("event_time"), F.when(timed, F.col("created_at")).alias("event_time_start"), F.when(timed, F.col("created_at") + 7200).alias("event_time_end"),
            F.when(timed, "minute").otherwise("day").alias("time_granularity"), F.lit(1.0).alias("time_confidence"), (i % 17 == 0).alias("is_deleted"), F.when(i % 17 == 0, F.col("created_at") + 60).alias("deleted_at"),
            F.when(i % 11 == 0, "quote").when(i % 7 == 0, "factual").when(i % 13 == 0, "").otherwise("mixed").alias("knowledge_type"),
        )
        # The few rows that go are what is shuffled and sent, not the texts.
        keyed = cut(p.select("hash", "doc_id"))
        first = keyed.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
        later = cut(keyed.join(first, ["hash", "doc_id"], "left_anti"))
        return p.where("doc_id is not null").join(later, ["hash", "doc_id"], "left_anti")

    @cached_property
    def names(self) -> DataFrame:
        t = [("customer", "c_name"), ("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"), ("part", "p_brand")]
        out = None
        for table, col in t:
            df = self.table(table).select(F.col(col).alias("name"))
            out = df if out is None else out.unionByName(df)
        return out.unionByName(self.table("documents").where("source is not null").select(F.col("source").alias("name")))  # names without an edge

    @cached_property
    def entity(self) -> DataFrame:
        return self.stored("entity", self._entity)

    def _entity(self) -> DataFrame:
        e = self.names.groupBy(tx.entity_hash(F.col("name")).alias("hash")).agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("appearance_count"))
        dead = F.substring("hash", 1, 1) == "3"
        return e.select("hash", "name", "appearance_count", F.lit(float(T0)).alias("created_at"), dead.alias("is_deleted"), F.when(dead, F.lit(T0 + 60.0)).alias("deleted_at"))

    @cached_property
    def triples(self) -> DataFrame:
        c, n, r, s = (self.table(x) for x in ("customer", "nation", "region", "supplier"))
        o, li, p = self.table("orders"), self.table("lineitem"), self.table("part")
        row = lambda df, a, v, b, k: df.groupBy(F.col(a).alias("subject"), F.lit(v).alias("predicate"), F.col(b).alias("object")).agg(F.count(F.lit(1)).alias("n"), F.min(k).alias("key"))
        cn = c.join(n, c.c_nationkey == n.n_nationkey)
        # Names come to the orders, brands to the lines: the lines are dealt by part, by order and for the counts, with few columns.
        named = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_custkey")
        buys = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand").join(named, F.col("l_orderkey") == F.col("o_orderkey"))
        return (
            row(cn, "c_name", "located_in", "n_name", "c_custkey")
            .unionByName(row(s.join(n, s.s_nationkey == n.n_nationkey), "s_name", "located_in", "n_name", "s_suppkey"))
            .unionByName(row(n.join(r, n.n_regionkey == r.r_regionkey), "n_name", "part_of", "r_name", "n_nationkey"))
            .unionByName(row(buys, "c_name", "buys", "p_brand", "c_custkey"))
        )

    @cached_property
    def relation(self) -> DataFrame:
        return self.stored("relation", self._relation)

    def _relation(self) -> DataFrame:
        h = tx.relation_hash(F.col("subject"), F.col("predicate"), F.col("object"))
        t = self.triples.withColumn("hash", h)
        d = lambda i: F.substring("hash", i, 1)
        idle = d(1).isin("1", "2")
        created = (F.lit(T0) + F.col("n") * 1000).cast("double")
        return t.select(
            "hash", "subject", "predicate", "object", F.least(F.lit(1.0), F.col("n") / 10.0).alias("confidence"),
            F.when(d(4).isin("0", "1"), "ready").when(d(4) == "2", "pending").when(d(4) == "3", "failed").alias("vector_state"), F.lit(None).cast("double").alias("vector_updated_at"),
            F.lit(None).cast("string").alias("vector_error"), F.when(d(4) == "3", 2).otherwise(0).alias("vector_retry_count"), created.alias("created_at"), F.lit(None).cast("string").alias("source_paragraph"),
            F.lit(False).alias("is_permanent"), F.lit(None).cast("double").alias("last_accessed"), F.lit(0).cast("bigint").alias("access_count"), idle.alias("is_inactive"),
            F.when(idle, F.lit(NOW) - F.col("n") * 40000).alias("inactive_since"), (d(2) == "5").alias("is_pinned"), F.when(d(3) == "7", F.lit(NOW + 100)).alias("protected_until"),
            F.when(d(5) == "9", F.lit(NOW - 10)).alias("last_reinforced"), "key",
        )

    @cached_property
    def edge(self) -> DataFrame:
        return self.stored("edge", self._edge)

    def _edge(self) -> DataFrame:
        """Most pairs have one relation: its row is the edge. Only the relations of pairs that have more are dealt and grouped."""
        r = self.relation.select(F.lower("subject").alias("src"), F.lower("object").alias("dst"), "confidence", "hash")
        r = r.withColumn("_pair", F.xxhash64("src", "dst"))
        more = cut(r.groupBy("_pair").count().where("count > 1").select("_pair"))
        one = r.join(more, "_pair", "left_anti").select("src", "dst", F.col("confidence").alias("weight"), F.array_compact(F.array("hash")).alias("relation_hashes"))
        # Dealt before they are grouped: sets of one digest each are wider than the rows, and digests half as wide as hex.
        many = r.join(more, "_pair", "left_semi").select("src", "dst", "confidence", F.unhex("hash").alias("h")).repartition("src", "dst").groupBy("src", "dst")
        sets = F.array_sort(F.transform(F.collect_set("h"), lambda h: F.lower(F.hex(h))))
        return one.unionByName(many.agg(F.sum("confidence").alias("weight"), sets.alias("relation_hashes")))

    @cached_property
    def node(self) -> DataFrame:
        return self.stored("node", lambda: self.names.groupBy(F.lower(F.trim("name")).alias("canon")).agg(F.min("name").alias("name")))

    def _linked(self, keyed: DataFrame) -> DataFrame:
        """Rows with a key, each with the paragraph whose doc_id is a hash of the key modulo the number of documents: some get many, some none."""
        n = self.table("documents").agg(F.count(F.lit(1)).alias("_n"))
        p = self.para.select(F.col("hash").alias("paragraph_hash"), "doc_id")
        spread = F.conv(F.substring(F.md5(F.col("key").cast("string")), 1, 8), 16, 10).cast("bigint")
        return keyed.crossJoin(F.broadcast(n)).withColumn("doc_id", spread % F.col("_n")).join(p, "doc_id")  # one row

    @cached_property
    def paragraph_relation(self) -> DataFrame:
        build = lambda: self._linked(self.relation.select(F.unhex("hash").alias("h"), "key")).select("paragraph_hash", F.lower(F.hex("h")).alias("relation_hash"))
        return self.stored("paragraph_relation", build)

    @cached_property
    def paragraph_entity(self) -> DataFrame:
        c = self.table("customer").select(tx.entity_hash(F.col("c_name")).alias("entity_hash"), F.col("c_custkey").alias("key"), (1 + F.col("c_custkey") % 3).cast("int").alias("mention_count"))
        return self.stored("paragraph_entity", lambda: self._linked(c).select("paragraph_hash", "entity_hash", "mention_count"))

    @cached_property
    def vector(self) -> DataFrame:
        return self.table("embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("hash"), F.when(F.col("vec_id") % 4 == 3, "relation").otherwise("paragraph").alias("item_type"), "embedding")

    @cached_property
    def ivf(self) -> ivf.Index:
        """The index of all vectors, written once for each application and folder."""
        key = (self.spark.sparkContext.applicationId, self.dir.rstrip("/"), "ivf")
        if key not in self._indexes or not exists(self.spark, self._indexes[key].path):
            dim = self.vector.select(F.max(F.size("embedding"))).first()[0] or 1
            self._indexes[key] = ivf.build(self.vector, dim)
        return self._indexes[key]

    @cached_property
    def queries(self) -> DataFrame:
        """Whole texts and embeddings of the rows with an id divisible by 100; one without the other asks with what it has."""
        d = self.table("documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), tx.normalize(F.col("text")).alias("text"))
        e = self.table("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
        return d.join(e, "query_id", "full").withColumn("text", F.coalesce("text", F.lit("")))

    @cached_property
    def posting(self) -> DataFrame:
        """Forward rows: the postings by paragraph."""
        return self.stored("posting", lambda: sparse.forward(self.para))

    @cached_property
    def relation_posting(self) -> DataFrame:
        return self.stored("relation_posting", lambda: sparse.forward(sparse.relation_docs(self.relation)))

    @cached_property
    def dense(self) -> DataFrame:
        """A ranked list: per supplier its parts by their dearest line."""
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("hash")).agg((F.max("l_extendedprice") / 199999.7).cast("double").alias("score"))

    @cached_property
    def words(self) -> DataFrame:
        """Another over some of the same keys: by the lines' quantity."""
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("hash")).agg((F.sum("l_quantity") / 100).cast("double").alias("score"))

    @cached_property
    def streams(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("stream_id"), F.concat(F.lit("g"), F.col("user_id") % 4).alias("group_id"), F.col("user_id").cast("string").alias("user_id")).distinct()

    @cached_property
    def chat(self) -> DataFrame:
        """Chat history: a row a conversation."""
        c = self.table("conversations")
        g = c.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("p"), F.min_by("text", "turn").alias("t"))
        first = F.split(tx.normalize(F.col("t")), " ")
        return g.select(F.col("conv_id").alias("id"), F.concat(F.lit("c"), F.col("conv_id") % 7).alias("chat_id"), F.col("conv_id").cast("double").alias("start_time"), (F.col("conv_id") + 60).cast("double").alias("end_time"), F.to_json("p").alias("participants"), first[0].alias("theme"), F.to_json(F.slice(first, 1, 3)).alias("keywords"), F.col("t").alias("summary"))

    @cached_property
    def deleted_relation(self) -> DataFrame:
        bin_ = self.relation.where("substring(hash, 1, 1) = '0'")
        lost = bin_.withColumn("hash", F.concat(F.lit("x"), F.substring("hash", 2, 63)))
        return bin_.unionByName(lost).withColumn("deleted_at", F.col("created_at") + 5)

    @cached_property
    def rebuild_source(self) -> DataFrame:
        s = self.table("documents").select("source").distinct()
        n = F.substring(F.md5("source"), 1, 1)
        status = F.when(n < "4", "pending").when(n < "8", "running").when(n < "c", "done").otherwise("failed")
        return s.select("source", status.alias("status"), F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("last_error"), F.lit("").alias("reason"), F.lit(float(T0)).alias("requested_at"), F.lit(float(T0)).alias("updated_at"))

    @cached_property
    def episode(self) -> DataFrame:
        """One episode a source: of its live paragraphs."""
        p = self.para.where("not is_deleted")
        g = p.groupBy("source").agg(F.min("created_at").alias("event_time_start"), F.max("created_at").alias("event_time_end"), F.count(F.lit(1)).cast("int").alias("paragraph_count"))
        return g.select(F.md5("source").alias("episode_id"), "source", F.concat(F.lit("about "), "source").alias("title"), F.concat(F.lit("notes of "), "source").alias("summary"), "event_time_start", "event_time_end", F.array(F.lit("Ann"), F.col("source")).alias("participants"), F.array(F.lit("notes"), F.lit("src1")).alias("keywords"), "paragraph_count", F.col("event_time_end").alias("updated_at"))

    @cached_property
    def episode_paragraph(self) -> DataFrame:
        return self.para.where("not is_deleted").select(F.md5("source").alias("episode_id"), F.col("hash").alias("paragraph_hash"), F.col("doc_id").cast("int").alias("position"))

    @cached_property
    def store(self) -> Tables:
        """All tables; each is written when it is first asked for, so that a query pays for those that it reads."""
        names = ("vector", "entity", "relation", "edge", "node", "paragraph_relation", "paragraph_entity", "deleted_relation", "rebuild_source", "episode", "episode_paragraph")
        return Tables({k: partial(getattr, self, k) for k in names} | {"paragraph": lambda: self.para})


NORM = r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\r\n?', chr(10), 'g'), '[^\S\n]+', ' ', 'g')"
_SQL = {
    "para": rf"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS rn FROM (
        SELECT sha256(content) AS hash, content, source, doc_id, len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')) AS word_count, c AS created_at, c AS updated_at,
        CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN c END AS event_time, CASE WHEN doc_id % 3 = 0 THEN c END AS event_time_start, CASE WHEN doc_id % 3 = 0 THEN c + 7200 END AS event_time_end,
        CASE WHEN doc_id % 3 = 0 THEN 'minute' ELSE 'day' END AS time_granularity, doc_id % 17 = 0 AS is_deleted,
        CASE WHEN doc_id % 11 = 0 THEN 'quote' WHEN doc_id % 7 = 0 THEN 'factual' WHEN doc_id % 13 = 0 THEN '' ELSE 'mixed' END AS knowledge_type
        FROM (SELECT doc_id, source, {NORM} AS content, CAST({T0} + doc_id * 3600 AS DOUBLE) AS c FROM documents))) WHERE rn = 1""",
    "names": "SELECT c_name AS name FROM customer UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier UNION ALL SELECT p_brand FROM part UNION ALL SELECT source FROM documents WHERE source IS NOT NULL",
    "entity": f"SELECT sha256(lower(trim(name))) AS hash, min(name) AS name, count(*) AS appearance_count, CAST({T0} AS DOUBLE) AS created_at, sha256(lower(trim(name)))[1] = '3' AS is_deleted FROM names GROUP BY 1",
    "triples": """SELECT c_name AS subject, 'located_in' AS predicate, n_name AS object, count(*) AS n, min(c_custkey) AS key FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
        UNION ALL SELECT s_name, 'located_in', n_name, count(*), min(s_suppkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL
        UNION ALL SELECT n_name, 'part_of', r_name, count(*), min(n_nationkey) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
        UNION ALL SELECT c_name, 'buys', p_brand, count(*), min(c_custkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "relation": f"""SELECT hash, subject, predicate, object, least(1.0, n / 10.0)::DOUBLE AS confidence, CASE WHEN hash[4] IN ('0', '1') THEN 'ready' WHEN hash[4] = '2' THEN 'pending' WHEN hash[4] = '3' THEN 'failed' END AS vector_state,
        CASE WHEN hash[4] = '3' THEN 2 ELSE 0 END AS vector_retry_count, CAST({T0} + n * 1000 AS DOUBLE) AS created_at, hash[1] IN ('1', '2') AS is_inactive, CASE WHEN hash[1] IN ('1', '2') THEN {NOW}::DOUBLE - n * 40000 END AS inactive_since,
        hash[2] = '5' AS is_pinned, CASE WHEN hash[3] = '7' THEN {NOW + 100}::DOUBLE END AS protected_until, CASE WHEN hash[5] = '9' THEN {NOW - 10}::DOUBLE END AS last_reinforced, key
        FROM (SELECT *, sha256(lower(subject) || '|' || lower(predicate) || '|' || lower(object)) AS hash FROM triples)""",
    "edge": "SELECT lower(subject) AS src, lower(object) AS dst, sum(confidence) AS weight, list_sort(list(DISTINCT hash)) AS relation_hashes FROM relation GROUP BY 1, 2",
    "node": "SELECT lower(trim(name)) AS canon, min(name) AS name FROM names GROUP BY 1",
    "paragraph_relation": "SELECT p.hash AS paragraph_hash, r.hash AS relation_hash FROM (SELECT hash, ('0x' || md5(key::VARCHAR)[1:8])::BIGINT % (SELECT count(*) FROM documents) AS doc_id FROM relation) r JOIN para p USING (doc_id)",
    "paragraph_entity": "SELECT p.hash AS paragraph_hash, entity_hash, mention_count FROM (SELECT sha256(lower(trim(c_name))) AS entity_hash, (1 + c_custkey % 3)::INT AS mention_count, ('0x' || md5(c_custkey::VARCHAR)[1:8])::BIGINT % (SELECT count(*) FROM documents) AS doc_id FROM customer) JOIN para p USING (doc_id)",
    "vector": "SELECT 'v' || vec_id AS hash, CASE WHEN vec_id % 4 = 3 THEN 'relation' ELSE 'paragraph' END AS item_type, embedding FROM embeddings",
    "queries": f"SELECT coalesce(doc_id, vec_id) AS query_id, coalesce(t, '') AS text, embedding FROM (SELECT doc_id, {NORM} AS t FROM documents WHERE doc_id % 100 = 0) FULL JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) ON vec_id = doc_id",
    "chat": f"SELECT conv_id AS id, 'c' || (conv_id % 7) AS chat_id, conv_id::DOUBLE AS start_time, (conv_id + 60)::DOUBLE AS end_time, string_split({NORM}, ' ')[1] AS theme, text AS summary FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id)",
    "dense": "SELECT l_suppkey AS query_id, 'p' || l_partkey AS hash, (max(l_extendedprice) / 199999.7)::DOUBLE AS score FROM lineitem GROUP BY 1, 2",
    "words": "SELECT l_suppkey AS query_id, 'p' || l_partkey AS hash, (sum(l_quantity) / 100)::DOUBLE AS score FROM lineitem GROUP BY 1, 2",
    "deleted_relation": "SELECT *, created_at + 5 AS deleted_at FROM relation WHERE hash[1] = '0' UNION ALL SELECT * REPLACE ('x' || hash[2:] AS hash), created_at + 5 FROM relation WHERE hash[1] = '0'",
    "rebuild_source": "SELECT source, CASE WHEN md5(source)[1] < '4' THEN 'pending' WHEN md5(source)[1] < '8' THEN 'running' WHEN md5(source)[1] < 'c' THEN 'done' ELSE 'failed' END AS status FROM (SELECT DISTINCT source FROM documents)",
    "episode": "SELECT md5(source) AS episode_id, source, 'about ' || source AS title, 'notes of ' || source AS summary, min(created_at) AS event_time_start, max(created_at) AS event_time_end, max(created_at) AS updated_at, count(*) AS paragraph_count FROM para WHERE NOT is_deleted GROUP BY source",
    "episode_paragraph": "SELECT md5(source) AS episode_id, hash AS paragraph_hash, doc_id AS position FROM para WHERE NOT is_deleted",
}
_NEEDS = {"entity": ["names"], "relation": ["triples"], "edge": ["relation"], "node": ["names"], "paragraph_relation": ["para", "relation"], "paragraph_entity": ["para"], "deleted_relation": ["relation"], "episode": ["para"], "episode_paragraph": ["para"]}

def with_tables(names: str, body: str) -> str:
    """`body` after the definitions of the named tables and what these need."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in _NEEDS.get(n, []):
            visit(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        visit(n)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({_SQL[n]})" for n in order)  # else each use of a table works it out again
    body = body.strip()
    head = re.match(r"(?i)WITH (RECURSIVE )?", body)
    return f"{head[0]}{ctes}, {body[head.end():]}" if head else f"WITH {ctes}\n{body}"
