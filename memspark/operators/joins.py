"""Bridge joins, semi- and anti-joins, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.time import effective_end, effective_start, overlaps
from .catalog import LIVE, blocked_sources
from .dml import first_by


def entities_of(bridge: DataFrame, entities: DataFrame) -> DataFrame:
    """J01"""
    return bridge.join(entities.withColumnRenamed("hash", "entity_hash"), "entity_hash").select("paragraph_hash", "entity_hash", "name", "mention_count")


def relations_of(bridge: DataFrame, relations: DataFrame) -> DataFrame:
    """J01"""
    return bridge.join(relations.withColumnRenamed("hash", "relation_hash"), "relation_hash").select("paragraph_hash", "relation_hash", "subject", "predicate", "object")


def paragraphs_of_entity(bridge: DataFrame, entities: DataFrame, paragraphs: DataFrame, name: str) -> DataFrame:
    """J02"""
    e = entities.where(tx.canonical(F.col("name")) == name.strip().lower()).select(F.col("hash").alias("entity_hash"))
    return bridge.join(e, "entity_hash", "left_semi").select(F.col("paragraph_hash").alias("hash")).distinct().join(paragraphs, "hash")


def orphan_recycled(deleted: DataFrame, relations: DataFrame) -> DataFrame:
    """Hashes of the bin that no relation has."""
    return deleted.select("hash").join(relations.select("hash"), "hash", "left_anti")


def paragraph_gc(paragraphs: DataFrame, by_entity: DataFrame, by_relation: DataFrame, before: float) -> DataFrame:
    """Live, old, and linked with nothing."""
    old = paragraphs.where(LIVE).where(F.col("created_at") < before)
    for bridge in (by_entity, by_relation):
        old = old.join(bridge.select(F.col("paragraph_hash").alias("hash")).distinct(), "hash", "left_anti")
    return old.select("hash")


def entity_gc(entities: DataFrame, isolated: DataFrame, bridge: DataFrame, paragraphs: DataFrame, before: float) -> DataFrame:
    """Live, old, isolated in the graph, and in no live paragraph."""
    held = bridge.join(paragraphs.where(LIVE).select(F.col("hash").alias("paragraph_hash")), "paragraph_hash", "left_semi").select(F.col("entity_hash").alias("hash")).distinct()
    old = entities.where(LIVE).where(F.col("created_at") < before).withColumn("canon", tx.canonical(F.col("name")))
    return old.join(isolated.select("canon"), "canon", "left_semi").join(held, "hash", "left_anti").select("hash", "name")


def visible_episodes(episodes: DataFrame, queue: DataFrame, lower: float | None = None, upper: float | None = None, source: str | None = None, person: str | None = None, bridge: DataFrame | None = None, by_entity: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Episodes of sources that aren't being rebuilt, that meet the window and name the person."""
    start = F.coalesce("event_time_start", "event_time_end", "updated_at")
    end = F.coalesce("event_time_end", "event_time_start", "updated_at")
    found = episodes.join(blocked_sources(queue), "source", "left_anti").where(overlaps(start, end, lower, upper))
    if source is not None:
        found = found.where(F.col("source") == source)
    if person is not None:
        named = F.exists("participants", lambda x: F.lower(x).contains(person.lower()))
        if bridge is None:
            return found.where(named)
        e = entities.where(F.lower("name").contains(person.lower())).select(F.col("hash").alias("entity_hash"))
        ids = bridge.join(by_entity.join(e, "entity_hash", "left_semi").select("paragraph_hash").distinct(), "paragraph_hash", "left_semi").select("episode_id", F.lit(True).alias("_p")).distinct()
        found = found.join(ids, "episode_id", "left").where(named | F.col("_p")).drop("_p")
    return found


def episodes_of_paragraphs(hits: DataFrame, bridge: DataFrame, episodes: DataFrame) -> DataFrame:
    """hits(query_id, hash): per query and episode the matched paragraphs."""
    j = hits.select("query_id", F.col("hash").alias("paragraph_hash")).join(bridge, "paragraph_hash").join(episodes, "episode_id")
    return j.groupBy("query_id", "episode_id").agg(F.array_sort(F.collect_set("paragraph_hash")).alias("matched_paragraphs"))


def episodes_of_relations(hits: DataFrame, by_relation: DataFrame, bridge: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per query and episode the matched relations and the paragraphs between."""
    j = hits.select("query_id", F.col("hash").alias("relation_hash")).join(by_relation, "relation_hash").join(bridge, "paragraph_hash").join(episodes, "episode_id")
    return j.groupBy("query_id", "episode_id").agg(F.array_sort(F.collect_set("relation_hash")).alias("matched_relations"), F.array_sort(F.collect_set("paragraph_hash")).alias("matched_paragraphs"))


def episode_paragraphs(bridge: DataFrame, paragraphs: DataFrame, limit: int = 100) -> DataFrame:
    """Each episode's evidence in order."""
    return bridge.where(F.col("position") < limit).join(paragraphs.withColumnRenamed("hash", "paragraph_hash"), "paragraph_hash").select("episode_id", "position", "paragraph_hash", "content")


def active_persons(active: DataFrame, switches: DataFrame, after: float | None = None, limit: int = 200) -> DataFrame:
    """Persons seen lately where the switch is on, last seen first."""
    a = active if after is None else active.where(F.col("last_seen_at") >= after)
    j = a.join(switches.where("enabled").select("stream_id", "user_id"), ["stream_id", "user_id"])
    return j.groupBy("person_id").agg(F.max("last_seen_at").alias("last_seen_at")).orderBy(F.desc("last_seen_at"), "person_id").limit(limit)


def best_support(bridge: DataFrame, paragraphs: DataFrame, lower: float | None = None, upper: float | None = None, created_fallback: bool = True) -> DataFrame:
    """Per relation the interval of the supporting paragraph that meets the window and ends last."""
    start, end = effective_start(created_fallback), effective_end(created_fallback)
    p = paragraphs.where(overlaps(start, end, lower, upper)).select(F.col("hash").alias("paragraph_hash"), start.alias("effective_start"), end.alias("effective_end"))
    return first_by(bridge.join(p, "paragraph_hash"), ["relation_hash"], F.desc_nulls_last("effective_end"), F.desc("paragraph_hash")).select("relation_hash", "paragraph_hash", "effective_start", "effective_end")


def audit(vectors: DataFrame, paragraphs: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Per kind how many rows have a vector, vectors without a row, and relation states that contradict."""
    out = None
    for kind, df in (("paragraph", paragraphs), ("entity", entities), ("relation", relations)):
        v = vectors.where(F.col("item_type") == kind).select("hash", F.lit(1).alias("v"))
        both = df.select("hash", F.lit(1).alias("d"), (F.col("vector_state") if kind == "relation" else F.lit(None).cast("string")).alias("state")).join(v, "hash", "full_outer")
        row = both.agg(F.lit(kind).alias("kind"), F.count("d").alias("n"), F.count_if(F.expr("d is not null and v is not null")).alias("covered"), F.count_if(F.expr("d is null")).alias("orphan_vectors"), F.count_if(F.expr("state = 'ready' and v is null")).alias("ready_but_missing"), F.count_if(F.expr("coalesce(state, 'ready') != 'ready' and v is not null")).alias("present_not_ready"))
        out = row if out is None else out.unionByName(row)
    return out


def orphan_relation_vectors(deleted: DataFrame, relations: DataFrame, vectors: DataFrame, limit: int = 200) -> DataFrame:
    """Vectors of relations that are only in the bin."""
    return orphan_recycled(deleted, relations).join(vectors.select("hash"), "hash", "left_semi").orderBy("hash").limit(limit)


def graph_view(edges: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges with their predicates and state; frozen edges (weight 0, hashes kept) are marked."""
    e = edges.select("src", "dst", "weight", F.explode_outer("relation_hashes").alias("hash"))
    j = e.join(relations.select("hash", "predicate", "is_inactive", "is_pinned"), "hash", "left")
    return j.groupBy("src", "dst", "weight").agg(F.array_sort(F.collect_set("predicate")).alias("predicates"), F.coalesce(F.bool_or("is_pinned"), F.lit(False)).alias("pinned"), F.coalesce(F.bool_and("is_inactive"), F.lit(False)).alias("inactive")).withColumn("frozen", F.col("weight") == 0)
