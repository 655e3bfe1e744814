"""Person profiles: aliases, evidence, text snapshots, overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import matcher
from .dml import append_snapshots, first_by
from .joins import active_persons


def aliases(persons: DataFrame) -> DataFrame:
    """persons(person_id, name, nickname, group_nicks json) to (person_id, alias, rank), each alias once."""
    nicks = F.from_json("group_nicks", "array<struct<group_nick_name:string>>")
    every = F.concat(F.array("name", "nickname"), F.coalesce(F.transform(nicks, lambda x: x["group_nick_name"]), F.array().cast("array<string>")))
    return persons.select("person_id", F.posexplode(tx.keep_order(F.array_compact(every))).alias("rank", "alias"))


def traits(raw_json):
    """The contents of "area:content:weight" strings."""
    return F.filter(F.transform(tx.json_list(raw_json), lambda x: F.when(F.size(F.split(x, ":")) >= 2, F.get(F.split(x, ":"), F.lit(1))).otherwise(x)), lambda x: tx.strip(x) != "")


def resolve(persons: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(key) to person_id: by id, then exact name or nickname, then a nickname of a group that contains it."""
    k = F.lower(F.trim("key"))
    by_id = wanted.join(persons.select("person_id"), F.col("key") == F.col("person_id")).select("key", "person_id", F.lit(0).alias("r"))
    al = aliases(persons)
    exact = wanted.withColumn("k", k).join(al.withColumn("k", F.lower("alias")), "k").select("key", "person_id", F.when(F.col("rank") <= 1, 1).otherwise(2).alias("r"))
    nicks = al.where("rank > 1")
    low = nicks.select("person_id", F.lower("alias").alias("alias"))
    hits = matcher.held(low, wanted.select(k.alias("k")), "person_id", "alias", "k").select(F.col("id").alias("person_id"), F.col("pattern").alias("k"))
    blank = wanted.where(k == "").join(F.broadcast(nicks.agg(F.min("person_id").alias("person_id")).where("person_id is not null")))  # one row: any name holds an empty key
    part = wanted.withColumn("k", k).join(hits, "k").select("key", "person_id").unionByName(blank.select("key", "person_id")).withColumn("r", F.lit(3))
    return first_by(by_id.unionByName(exact).unionByName(part), ["key"], F.col("r"), F.col("person_id")).select("key", "person_id")


def relation_evidence(names: DataFrame, relations: DataFrame, limit: int = 30) -> DataFrame:
    """names(person_id, alias): relations at an alias, the surest first."""
    a = names.select("person_id", F.lower("alias").alias("k"))
    ends = [relations.where("not coalesce(is_inactive, false)").select("hash", "subject", "predicate", "object", "confidence", F.lower(c).alias("k")) for c in ("subject", "object")]
    j = a.join(ends[0].unionByName(ends[1]), "k").dropDuplicates(["person_id", "hash"])
    w = Window.partitionBy("person_id").orderBy(F.desc("confidence"), "hash")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("k")


def text_evidence(hits: DataFrame, paragraphs: DataFrame, limit: int = 12) -> DataFrame:
    """hits(person_id, hash, score) with their texts, the best first, each once."""
    best = hits.groupBy("person_id", "hash").agg(F.max("score").alias("score"))
    w = Window.partitionBy("person_id").orderBy(F.desc("score"), "hash")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).join(paragraphs.select("hash", "content"), "hash")


def build(names: DataFrame, edges: DataFrame, texts: DataFrame, now: float, ttl_s: float = 6 * 3600) -> DataFrame:
    """One profile text a person from aliases, the first ten relations and the first six texts."""
    line = lambda df, k, c: df.where(F.col("rank") <= k).groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", c.alias("c")))), lambda y: y["c"]).alias("x"))
    a = line(names.withColumn("rank", F.col("rank") + 1), 20, F.col("alias")).withColumnRenamed("x", "aliases")
    r = line(edges, 10, F.concat_ws(" ", "subject", "predicate", "object")).withColumnRenamed("x", "relation_edges")
    t = line(texts, 6, F.substring("content", 1, 200)).withColumnRenamed("x", "vector_evidence")
    ids = edges.select("person_id", "hash").unionByName(texts.select("person_id", "hash")).groupBy("person_id").agg(F.array_sort(F.collect_set("hash")).alias("evidence_ids"))
    empty = F.array().cast("array<string>")
    j = a.join(r, "person_id", "left").join(t, "person_id", "left").join(ids, "person_id", "left")
    j = j.withColumns({c: F.coalesce(c, empty) for c in ("relation_edges", "vector_evidence", "evidence_ids")})
    body = F.concat_ws("\n", F.concat(F.lit("aliases: "), F.array_join("aliases", ", ")), F.concat(F.lit("relations: "), F.array_join("relation_edges", "; ")), F.concat(F.lit("evidence: "), F.array_join("vector_evidence", " / ")))
    return j.select("person_id", body.alias("profile_text"), "aliases", "relation_edges", "vector_evidence", "evidence_ids", F.lit(now).alias("updated_at"), F.lit(now + ttl_s).alias("expires_at"), F.lit("").alias("source_note"))


def refresh(persons: DataFrame, active: DataFrame, switches: DataFrame, snapshots: DataFrame, relations: DataFrame, hits: DataFrame, paragraphs: DataFrame, now: float, hours: float = 72.0, most: int = 50) -> DataFrame:
    """New snapshots for persons that were active lately where the switch is on, unless theirs is still fresh."""
    due = active_persons(active, switches, now - hours * 3600, most).select("person_id")
    fresh = latest(snapshots).select("person_id").join(stale(snapshots, now).select("person_id"), "person_id", "left_anti")
    mine = persons.join(due.join(fresh, "person_id", "left_anti"), "person_id", "left_semi")
    names = aliases(mine)
    return append_snapshots(snapshots, build(names, relation_evidence(names, relations), text_evidence(hits, paragraphs), now))


def latest(snapshots: DataFrame) -> DataFrame:
    """R47"""
    return first_by(snapshots, ["person_id"], F.desc("profile_version"))


def stale(snapshots: DataFrame, now: float, ttl_s: float = 6 * 3600) -> DataFrame:
    """Latest snapshots beyond their expiry, or older than the ttl."""
    return latest(snapshots).where(F.when(F.col("expires_at").isNotNull(), F.col("expires_at") <= now).otherwise(F.col("updated_at") + ttl_s <= now))


def with_override(profiles: DataFrame, overrides: DataFrame) -> DataFrame:
    """A manual text goes before the built one."""
    j = profiles.join(overrides.select("person_id", "override_text"), "person_id", "left")
    return j.withColumn("overridden", F.col("override_text").isNotNull()).withColumn("profile_text", F.coalesce("override_text", "profile_text")).drop("override_text")


def injection_enabled(pairs: DataFrame, switches: DataFrame, default: bool = False, module_on: bool = True) -> DataFrame:
    """pairs(stream_id, user_id) with enabled."""
    j = pairs.join(switches.select("stream_id", "user_id", F.col("enabled").alias("_e")), ["stream_id", "user_id"], "left")
    return j.withColumn("enabled", F.lit(module_on) & F.coalesce("_e", F.lit(default))).drop("_e")


def block(profile_text, most_lines: int = 12):
    """The first lines, for a prompt."""
    return F.array_join(F.slice(F.split(profile_text, "\n"), 1, most_lines), "\n")
