"""Readers, their filters and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vx

CHAT_HISTORY = "id bigint, chat_id string, start_time double, end_time double, participants string, theme string, keywords string, summary string"


def sql(spark: SparkSession, query: str, views: dict[str, DataFrame], **args) -> DataFrame:
    """A query over named frames, with named parameters."""
    return spark.sql(query, args=args or None, **views)


def chat_history(spark: SparkSession, path: str) -> DataFrame:
    """By schema; Spark splits the scan, so there are no pages."""
    return spark.read.schema(CHAT_HISTORY).parquet(path)


def chat_history_jdbc(spark: SparkSession, url: str, table: str, low: int, high: int, parts: int = 16, **options: str) -> DataFrame:
    """The same from a database, split by id."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="id", lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def selection(id_from: int | None = None, id_to: int | None = None, after_id: int | None = None, streams: list[str] | None = None, time_from: float | None = None, time_to: float | None = None) -> Column:
    """The predicate of a selection; an empty list of streams selects nothing."""
    p = F.lit(True)
    for ok, cond in ((id_from, F.col("id") >= (id_from or 0)), (id_to, F.col("id") <= (id_to or 0)), (after_id, F.col("id") > (after_id or 0)), (time_from, F.col("end_time") >= (time_from or 0)), (time_to, F.col("start_time") <= (time_to or 0))):
        p = p & cond if ok is not None else p
    if streams is not None:
        p = p & (F.col("chat_id").isin(*streams) if streams else F.lit(False))
    return p


def chat_counts(rows: DataFrame, limit: int = 30) -> DataFrame:
    """The chats with the most rows."""
    return rows.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "chat_id").limit(limit)


def preview(rows: DataFrame, limit: int = 20) -> DataFrame:
    """S05"""
    return rows.orderBy("id").limit(limit)


def sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """N rows by a hash of the id, the same in each run."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)


def resolve_streams(streams: DataFrame, stream_ids: list[str], group_ids: list[str], user_ids: list[str]) -> DataFrame:
    """streams(stream_id, group_id, user_id): ids given, and those of the groups and users."""
    hit = F.col("stream_id").isin(*stream_ids) | F.col("group_id").isin(*group_ids) | F.col("user_id").isin(*user_ids)
    return streams.where(hit).select("stream_id").distinct()


def parse_relation(c: Column) -> Column:
    """struct(subject, predicate, object) of s|p|o, s->p->o, or words; empty strings if it is none."""
    t = tx.strip(c)
    cut = lambda sep: F.filter(F.transform(F.split(t, sep), tx.strip), lambda x: x != "")
    pipes, arrows, spaces = cut(r"\|"), cut("->"), cut(r"(?U)\s+")
    part = lambda xs, i: F.get(xs, F.lit(i))
    three = lambda xs: F.struct(part(xs, 0).alias("subject"), part(xs, 1).alias("predicate"), part(xs, 2).alias("object"))
    rest = F.struct(part(spaces, 0).alias("subject"), part(spaces, 1).alias("predicate"), F.array_join(F.slice(spaces, 3, F.greatest(F.size(spaces) - 2, F.lit(1))), " ").alias("object"))
    none = F.struct(F.lit("").alias("subject"), F.lit("").alias("predicate"), F.lit("").alias("object"))
    return F.when(t.contains("|") & (F.size(pipes) >= 3), three(pipes)).when(t.contains("->") & (F.size(arrows) >= 3), three(arrows)).when(F.size(spaces) >= 3, rest).otherwise(none)


def relations_from(df: DataFrame) -> DataFrame:
    """Triples from columns, or else from a text column; incomplete ones are left out."""
    have = set(df.columns)
    parsed = parse_relation(F.col("text")) if "text" in have else None
    pick = lambda c: F.coalesce(*([F.nullif(tx.strip(F.col(c)), F.lit(""))] if c in have else []), *([parsed[c]] if parsed is not None else []), F.lit(""))
    out = df.select(*[pick(c).alias(c) for c in ("subject", "predicate", "object")])
    return out.where("subject != '' and predicate != '' and object != ''")


def vectors_from(df: DataFrame, dim: int, item_type: str = "paragraph") -> tuple[DataFrame, DataFrame]:
    """(vectors, rejected): rows str|content and embedding; without text, or of another dimension, they are rejected."""
    text = F.col("content") if "content" in df.columns else F.col("str")
    ok = (tx.strip(text) != "") & vx.is_valid(F.col("embedding"), dim)
    hashed = tx.entity_hash(text) if item_type == "entity" else tx.content_hash(tx.normalize(text))
    good = df.where(F.coalesce(ok, F.lit(False))).select(hashed.alias("hash"), F.lit(item_type).alias("item_type"), F.col("embedding").cast("array<float>").alias("embedding"))
    return good.dropDuplicates(["hash"]), df.where(~F.coalesce(ok, F.lit(False)))


def graph_from(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(id, name) and links(source, target, weight) to edges of canonical names; links to unknown ids are left out."""
    n = nodes.select("id", tx.canonical(F.col("name")).alias("canon"))
    j = links.join(n.select(F.col("id").alias("source"), F.col("canon").alias("src")), "source").join(n.select(F.col("id").alias("target"), F.col("canon").alias("dst")), "target")
    return j.groupBy("src", "dst").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight")).withColumn("relation_hashes", F.array().cast("array<string>"))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a GraphML file."""
    rows = lambda tag: spark.read.format("xml").option("rowTag", tag).load(path)
    nodes, links = rows("node"), rows("edge")
    return nodes.select(F.col("_id").cast("string").alias("id"), F.col("_id").cast("string").alias("name")), links.select(F.col("_source").cast("string").alias("source"), F.col("_target").cast("string").alias("target"), F.lit(1.0).alias("weight"))


def openie(spark: SparkSession, path: str) -> DataFrame:
    """(content, entities, relations) of an OpenIE JSON file; passages that are blank are left out."""
    schema = "docs array<struct<passage:string,extracted_triples:array<array<string>>,extracted_entities:array<string>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("docs").alias("d")).select("d.*")
    empty = F.array().cast("array<string>")
    triples = F.filter(F.coalesce("extracted_triples", F.array().cast("array<array<string>>")), lambda t: F.size(t) == 3)
    relations = F.transform(triples, lambda t: F.struct(t[0].alias("subject"), t[1].alias("predicate"), t[2].alias("object")))
    return d.where(tx.strip(F.col("passage")) != "").select(F.col("passage").alias("content"), tx.keep_order(F.coalesce("extracted_entities", empty)).alias("entities"), relations.alias("relations"))


def text_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, extensions: tuple[str, ...] = (".txt", ".md", ".json")) -> DataFrame:
    """(path, content, md5) of whole files with an allowed extension."""
    df = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    ok = F.lit(False)
    for e in extensions:
        ok = ok | F.lower("path").endswith(e)
    return df.where(ok).withColumn("md5", F.md5("content"))


def not_imported(files: DataFrame, manifest: DataFrame, policy: str = "content_hash") -> DataFrame:
    """Files that the manifest lacks, by content or by path; policy none lets all through."""
    if policy == "none":
        return files
    key = "md5" if policy == "content_hash" else "path"
    return files.join(manifest.select(key), key, "left_anti")


def record_import(files: DataFrame, manifest: DataFrame, task_id: str, now: float) -> DataFrame:
    """The manifest with the files just imported, one row a path."""
    new = files.select("path", "md5", F.lit(task_id).alias("task_id"), F.lit(now).alias("imported_at"))
    return manifest.join(new.select("path"), "path", "left_anti").unionByName(new)


def invalidate(manifest: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sources(source) as kind:value with kind file, path or md5: (manifest without their rows, sources that matched none)."""
    parts = F.split("source", ":", 2)
    s = sources.select("source", F.lower(parts[0]).alias("kind"), F.get(parts, F.lit(1)).alias("value"))
    m = manifest.select("path", "md5", F.element_at(F.split("path", "/"), -1).alias("file"))
    hit = None
    for kind in ("file", "path", "md5"):
        h = s.where(F.col("kind") == kind).join(m.withColumn("value", F.col(kind)).select("value", F.col("path").alias("hit")), "value").select("source", "hit")
        hit = h if hit is None else hit.unionByName(h)
    return manifest.join(hit.select(F.col("hit").alias("path")), "path", "left_anti"), sources.join(hit.select("source"), "source", "left_anti")


def embed_missing(texts: DataFrame, cache: DataFrame, embed) -> tuple[DataFrame, DataFrame]:
    """texts(text) embedded by a Column function, known ones from the cache(hash, embedding). Returns (rows, new cache)."""
    keyed = texts.withColumn("hash", tx.content_hash(F.col("text")))
    new = keyed.select("hash", "text").dropDuplicates(["hash"]).join(cache.select("hash"), "hash", "left_anti").select("hash", embed(F.col("text")).alias("embedding"))
    both = cache.unionByName(new.where(vx.is_valid(F.col("embedding"))))
    return keyed.join(both, "hash", "left"), both


def hashing_embedder(dim: int = 64):
    """A deterministic embedder without a model: signed hashed words, of unit length."""
    def embed(c: Column) -> Column:
        h = F.transform(tx.words(c), lambda w: F.xxhash64(w))
        sums = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(h, F.lit(0.0), lambda s, x: s + F.when(F.pmod(x, F.lit(dim)) == i, F.when(F.pmod(F.shiftright(x, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
        return vx.normalize(sums).cast("array<float>")

    return embed
