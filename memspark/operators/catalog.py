"""Lookups, listings, statistics and the recycle bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.time import effective_end, effective_start, overlaps
from ..schemas import QUEUE_STATES, VECTOR_STATES

LIVE = "is_deleted is null or not is_deleted"


def lookup(df: DataFrame, key: str, column: str = "hash") -> DataFrame:
    """The row of a key, whatever its state."""
    return df.where(F.col(column) == key)


def relations_by(relations: DataFrame, subject: str | None = None, predicate: str | None = None, object: str | None = None) -> DataFrame:
    """Conjunctive filter, whatever the case."""
    for c, v in (("subject", subject), ("predicate", predicate), ("object", object)):
        if v is not None:
            relations = relations.where(F.lower(c) == F.lower(F.lit(v)))
    return relations


def of_person(paragraphs: DataFrame, bridge: DataFrame, entities: DataFrame, person: str) -> DataFrame:
    """Paragraphs with an entity whose name contains the person's."""
    named = entities.where(F.lower("name").contains(person.lower())).select(F.col("hash").alias("entity_hash"))
    hit = bridge.join(named, "entity_hash", "left_semi").select(F.col("paragraph_hash").alias("hash")).distinct()
    return paragraphs.join(hit, "hash", "left_semi")


def paragraphs_in_time(paragraphs: DataFrame, lower: float | None = None, upper: float | None = None, source: str | None = None, limit: int | None = 100, created_fallback: bool = True) -> DataFrame:
    """Live paragraphs that meet the window, newest first."""
    start, end = effective_start(created_fallback), effective_end(created_fallback)
    found = paragraphs.where(LIVE).where(overlaps(start, end, lower, upper))
    if source is not None:
        found = found.where(F.col("source") == source)
    found = found.withColumns({"effective_start": start, "effective_end": end}).orderBy(F.desc_nulls_last("effective_end"), F.desc_nulls_last("updated_at"), "hash")
    return found if limit is None else found.limit(limit)


def paragraphs_containing(paragraphs: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring; deleted rows too."""
    return paragraphs.where(F.lower("content").contains(text.lower()))


def relations_containing(relations: DataFrame, text: str, limit: int = 5, deleted: DataFrame | None = None) -> DataFrame:
    """Substring of subject or object; from the bin when nothing live is found."""
    hit = lambda df: df.where(F.lower("subject").contains(text.lower()) | F.lower("object").contains(text.lower()))
    live = hit(relations).orderBy("hash").limit(limit)
    if deleted is None:
        return live
    binned = hit(deleted).select(*relations.columns).orderBy("hash").limit(limit)
    some = live.agg(F.count(F.lit(1)).alias("_n"))
    return live.unionByName(binned.crossJoin(F.broadcast(some)).where("_n = 0").drop("_n"))  # `some` is one row


def by_source(paragraphs: DataFrame, source: str, live: bool = False) -> DataFrame:
    """Equal sources; live: trimmed ones, in order of creation."""
    if not live:
        return paragraphs.where(F.col("source") == source)
    return paragraphs.where(LIVE).where(tx.strip(F.col("source")) == source.strip()).orderBy("created_at", "hash")


def triples(relations: DataFrame) -> DataFrame:
    """P07"""
    return relations.select("subject", "predicate", "object", "hash")


def status(df: DataFrame, hashes: DataFrame, columns: list[str]) -> DataFrame:
    """Chosen columns of the given hashes."""
    return df.join(hashes.select("hash").distinct(), "hash").select("hash", *columns)


def by_vector_state(relations: DataFrame, states: list[str], limit: int = 200, max_retry: int | None = None) -> DataFrame:
    """Those waiting longest first."""
    found = relations.where(F.coalesce("vector_state", F.lit("none")).isin(*states))
    if max_retry is not None:
        found = found.where(F.coalesce("vector_retry_count", F.lit(0)) < max_retry)
    return found.orderBy(F.coalesce("vector_updated_at", "created_at", F.lit(0.0)), "hash").limit(limit)


def protected(relations: DataFrame, now: float) -> DataFrame:
    """P10: pinned, or protected beyond now."""
    return relations.where(F.coalesce("is_pinned", F.lit(False)) | F.coalesce(F.col("protected_until") > now, F.lit(False))).select("hash")


def prune_candidates(relations: DataFrame, cutoff: float, limit: int = 1000) -> DataFrame:
    """P10: inactive since before the cutoff."""
    return relations.where(F.col("is_inactive") & (F.col("inactive_since") < cutoff)).orderBy("inactive_since", "hash").limit(limit)


def newest_deleted(df: DataFrame, limit: int = 50) -> DataFrame:
    """P11"""
    return df.where("deleted_at is not null").orderBy(F.desc("deleted_at"), "hash").limit(limit)


def recycle_bin(deleted_relations: DataFrame, entities: DataFrame, limit: int = 50) -> DataFrame:
    """Both kinds, newest first."""
    r = deleted_relations.select("hash", F.concat_ws(" ", "subject", "predicate", "object").alias("label"), "deleted_at", F.lit("relation").alias("kind"))
    e = entities.where("is_deleted").select("hash", F.col("name").alias("label"), "deleted_at", F.lit("entity").alias("kind"))
    return r.unionByName(e).orderBy(F.desc_nulls_last("deleted_at"), "hash").limit(limit)


def chat_enabled(chats: DataFrame, patterns: list[str], mode: str = "whitelist") -> DataFrame:
    """chats(stream_id, group_id, user_id) with enabled. Patterns: group:x, user:x or private:x, stream:x, or a bare id of any kind."""
    hit: Column = F.lit(False)
    for p in patterns:
        kind, sep, value = p.strip().partition(":")
        cols = {"group": ["group_id"], "user": ["user_id"], "private": ["user_id"], "stream": ["stream_id"]}.get(kind if sep else "", ["stream_id", "group_id", "user_id"])
        for c in cols:
            hit = hit | F.coalesce(F.col(c) == (value if sep else p.strip()), F.lit(False))
    return chats.withColumn("enabled", hit if mode == "whitelist" else ~hit)


def blocked_sources(queue: DataFrame) -> DataFrame:
    """Sources whose episodes are being rebuilt or failed to."""
    return queue.where(F.col("status").isin("pending", "running", "failed")).select("source").distinct()


def still_referenced(entities: DataFrame, bridge: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities that a bridge row or a relation names."""
    ends = relations.select(tx.entity_hash(F.col("subject")).alias("hash")).union(relations.select(tx.entity_hash(F.col("object"))))
    return entities.join(bridge.select(F.col("entity_hash").alias("hash")).union(ends).distinct(), "hash", "left_semi")


def entity_cards(entities: DataFrame, edges: DataFrame, bridge: DataFrame) -> DataFrame:
    """Out-neighbours and paragraphs of each of the given entities; lists are made for these alone."""
    names = entities.select(tx.canonical(F.col("name")).alias("src")).distinct()
    edges = edges.join(names, "src", "left_semi")
    bridge = bridge.join(entities.select(F.col("hash").alias("entity_hash")), "entity_hash", "left_semi")
    out = edges.where("weight > 0").groupBy(F.col("src").alias("canon")).agg(F.array_sort(F.collect_set("dst")).alias("neighbors"))
    held = bridge.groupBy(F.col("entity_hash").alias("hash")).agg(F.array_sort(F.collect_set("paragraph_hash")).alias("paragraphs"))
    empty = F.array().cast("array<string>")
    joined = entities.withColumn("canon", tx.canonical(F.col("name"))).join(out, "canon", "left").join(held, "hash", "left")
    return joined.select("hash", "name", F.coalesce("neighbors", empty).alias("neighbors"), F.coalesce("paragraphs", empty).alias("paragraphs"))


def totals(paragraphs: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of counts and words."""
    p = paragraphs.agg(F.count(F.lit(1)).alias("paragraphs"), F.coalesce(F.sum("word_count"), F.lit(0)).cast("bigint").alias("words"))
    return p.crossJoin(entities.agg(F.count(F.lit(1)).alias("entities"))).crossJoin(relations.agg(F.count(F.lit(1)).alias("relations")))  # single rows


def paragraph_counts(paragraphs: DataFrame) -> DataFrame:
    """A02"""
    return paragraphs.agg(F.count(F.lit(1)).alias("every"), F.count_if(F.expr(LIVE)).alias("live"), F.count_if("is_deleted").alias("deleted"))


def sources(paragraphs: DataFrame) -> DataFrame:
    """Count and last creation of each named source, newest first."""
    named = paragraphs.where("source is not null and source != ''")
    return named.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_created")).orderBy(F.desc("last_created"), "source")


def type_distribution(paragraphs: DataFrame) -> DataFrame:
    """A04"""
    return paragraphs.where("not is_deleted").groupBy(F.coalesce(F.nullif("knowledge_type", F.lit("")), F.lit("unknown")).alias("knowledge_type")).agg(F.count(F.lit(1)).alias("n"))


def vector_states(relations: DataFrame) -> DataFrame:
    """Counts of all four states, and in all."""
    state = F.coalesce("vector_state", F.lit("none"))
    return relations.agg(*[F.count_if(state == s).alias(s) for s in VECTOR_STATES], F.count(F.lit(1)).alias("total"))


def memory_status(relations: DataFrame, now: float) -> DataFrame:
    """Conditional counts in one pass."""
    idle, pinned = F.coalesce("is_inactive", F.lit(False)), F.coalesce("is_pinned", F.lit(False))
    return relations.agg(F.count_if(~idle).alias("active"), F.count_if(idle).alias("inactive"), F.count_if(pinned).alias("pinned"), F.count_if(F.coalesce(F.col("protected_until") > now, F.lit(False))).alias("protected"), F.count(F.lit(1)).alias("total"))


def snapshot_key(relations: DataFrame) -> DataFrame:
    """What changes when the relations do."""
    return relations.agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_created"), F.max("hash").alias("last_hash"))


def rebuild_summary(queue: DataFrame) -> DataFrame:
    """Counts of each queue state."""
    return queue.agg(*[F.count_if(F.col("status") == s).alias(s) for s in QUEUE_STATES])


def rebuild_list(queue: DataFrame, statuses: list[str], limit: int = 100) -> DataFrame:
    """A09"""
    return queue.where(F.col("status").isin(*statuses)).orderBy(F.desc("updated_at"), "source").limit(limit)


def report(paragraphs: DataFrame, relations: DataFrame, now: float) -> DataFrame:
    """Name, value and share of each counter."""
    p = paragraph_counts(paragraphs).selectExpr("stack(3, 'paragraphs', every, every, 'live paragraphs', live, every, 'deleted paragraphs', deleted, every) as (counter, value, whole)")
    r = memory_status(relations, now).selectExpr("stack(4, 'relations', total, total, 'inactive relations', inactive, total, 'pinned relations', pinned, total, 'protected relations', protected, total) as (counter, value, whole)")
    return p.unionByName(r).select("counter", "value", F.when(F.col("whole") > 0, F.round(F.col("value") / F.col("whole") * 100, 2)).otherwise(0.0).alias("percent"))


def sources_of(paragraphs: DataFrame, hashes: DataFrame, deleted_too: bool = True) -> DataFrame:
    """Distinct trimmed sources."""
    p = paragraphs if deleted_too else paragraphs.where(LIVE)
    return p.join(hashes.select("hash"), "hash", "left_semi").select(tx.strip(F.col("source")).alias("source")).where("source != ''").distinct()
