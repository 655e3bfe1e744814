"""Memory lifecycle as functions of `now`: reinforce, decay, freeze, prune, collect, restore."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Memory
from ..functions import text as tx
from ..sources.snapshot import Tables
from . import graph
from .dml import delete_rows, mark_deleted, recycle, restore, update
from .joins import entity_gc, paragraph_gc


def _ends(relations: DataFrame) -> DataFrame:
    return relations.withColumns({"src": tx.canonical(F.col("subject")), "dst": tx.canonical(F.col("object"))})


def reinforce(store: dict[str, DataFrame], hits: DataFrame, now: float, config: Memory = Memory(), max_weight: float = 10.0) -> dict[str, DataFrame]:
    """hits(hash): relations beyond their cooldown gain 1 - confidence / max on their edge, come back if inactive, and are protected."""
    rel = store["relation"]
    due = rel.join(hits.select("hash").distinct(), "hash", "left_semi").where(F.coalesce(F.col("last_reinforced") + config.cooldown_s <= now, F.lit(True)))
    gain = _ends(due).groupBy("src", "dst").agg(F.sum(1 - F.coalesce("confidence", F.lit(1.0)) / max_weight).alias("delta"))
    idle = F.coalesce("is_inactive", F.lit(False))
    out = update(
        rel, due.select("hash"), "hash",
        confidence=F.when(idle, F.greatest("confidence", F.lit(config.revive_to))).otherwise(F.col("confidence")),
        is_inactive=F.lit(False), inactive_since=F.lit(None).cast("double"), last_reinforced=F.lit(now),
        protected_until=F.greatest(F.coalesce("protected_until", F.lit(0.0)), F.lit(now + config.protect_s)),
        access_count=F.coalesce("access_count", F.lit(0)) + 1, last_accessed=F.lit(now),
    )
    return store | {"relation": out, "edge": graph.shift_weights(store["edge"], gain, high=max_weight)}


def decay_factor(hours: float, half_life_hours: float) -> float:
    """M01"""
    return 0.5 ** (hours / half_life_hours) if half_life_hours > 0 else 1.0


def freeze(store: dict[str, DataFrame], now: float, config: Memory = Memory()) -> dict[str, DataFrame]:
    """Weak edges none of whose relations is pinned or protected: relations inactive, weight 0."""
    weak = graph.low_weight(store["edge"], config.prune_below).select("src", "dst", F.explode_outer("relation_hashes").alias("hash"))
    safe = store["relation"].select("hash", (F.coalesce("is_pinned", F.lit(False)) | F.coalesce(F.col("protected_until") > now, F.lit(False))).alias("safe"))
    e = weak.join(safe, "hash", "left").groupBy("src", "dst").agg(F.bool_or(F.coalesce("safe", F.lit(False))).alias("safe")).where("not safe")
    hashes = weak.join(e.select("src", "dst"), ["src", "dst"], "left_semi").where("hash is not null").select("hash").distinct()
    rel = update(store["relation"], hashes, "hash", inactive_since=F.when(F.coalesce("is_inactive", F.lit(False)), F.col("inactive_since")).otherwise(F.lit(now)), is_inactive=F.lit(True))
    return store | {"relation": rel, "edge": graph.deactivate(store["edge"], e)}


def prune(store: dict[str, DataFrame], now: float, config: Memory = Memory()) -> dict[str, DataFrame]:
    """Relations inactive for longer than freeze_s go to the bin, and out of their edge's set."""
    gone = store["relation"].where(F.col("is_inactive") & (F.col("inactive_since") < now - config.freeze_s))
    ops = _ends(gone).select("src", "dst", "hash")
    return Tables() | recycle(store, gone, now) | {"edge": lambda: graph.prune_hashes(store["edge"], ops)}  # edges are made when asked for


def collect_orphans(store: dict[str, DataFrame], now: float, config: Memory = Memory()) -> dict[str, DataFrame]:
    """Marks isolated entities and unlinked paragraphs, sweeps those marked longer than the grace, drops their nodes."""
    alone = graph.isolated(store["node"], store["edge"], frozen_count=True)
    old = now - config.retention_s
    ent = mark_deleted(store["entity"], entity_gc(store["entity"], alone, store["paragraph_entity"], store["paragraph"], old), now)
    par = mark_deleted(store["paragraph"], paragraph_gc(store["paragraph"], store["paragraph_entity"], store["paragraph_relation"], old), now)
    e_gone, p_gone = sweepable(ent, now - config.grace_s), sweepable(par, now - config.grace_s)
    names = e_gone.select(tx.canonical(F.col("name")).alias("canon"))
    return store | {"entity": delete_rows(ent, e_gone), "paragraph": delete_rows(par, p_gone), "node": store["node"].join(names, "canon", "left_anti")}


def sweepable(df: DataFrame, before: float) -> DataFrame:
    """M06"""
    return df.where(F.col("is_deleted") & (F.col("deleted_at") < before))


def maintain(store: dict[str, DataFrame], hits: DataFrame, now: float, config: Memory = Memory()) -> dict[str, DataFrame]:
    """One tick as a batch: reinforce, decay, freeze, prune, collect."""
    store = reinforce(store, hits, now, config)
    store = store | {"edge": graph.decay(store["edge"], decay_factor(config.tick_hours, config.half_life_hours))}
    return collect_orphans(prune(freeze(store, now, config), now, config), now, config)


def set_active(relations: DataFrame, hashes: DataFrame, active: bool, now: float, boost: float | None = None) -> DataFrame:
    """M05"""
    keys = hashes.select("hash").distinct()
    if active:
        conf = {"confidence": F.greatest("confidence", F.lit(boost))} if boost is not None else {}
        return update(relations, keys, "hash", is_inactive=F.lit(False), inactive_since=F.lit(None).cast("double"), **conf)
    return update(relations, keys, "hash", is_inactive=F.lit(True), inactive_since=F.lit(now))


def protect(relations: DataFrame, hashes: DataFrame, now: float, hours: float) -> DataFrame:
    """Hours <= 0 pins; otherwise protected for so long. Both fields are set."""
    pin = hours <= 0
    return update(relations, hashes.select("hash").distinct(), "hash", is_pinned=F.lit(pin), protected_until=F.lit(None if pin else now + hours * 3600).cast("double"))


def modify(store: dict[str, DataFrame], hashes: DataFrame, action: str, strength: float, now: float) -> dict[str, DataFrame]:
    """Reinforce +0.5 s, weaken -0.5 s, forget -2 s on the edges of the relations; remember_forever pins."""
    if action == "remember_forever":
        return store | {"relation": protect(store["relation"], hashes, now, 0)}
    delta = {"reinforce": 0.5, "weaken": -0.5, "forget": -2.0}[action] * strength
    rel = _ends(store["relation"].join(hashes.select("hash"), "hash", "left_semi"))
    return store | {"edge": graph.shift_weights(store["edge"], rel.groupBy("src", "dst").agg(F.lit(delta).alias("delta")))}


def restore_memory(store: dict[str, DataFrame], hashes: DataFrame, weight: float = 1.0) -> dict[str, DataFrame]:
    """Relations back from the bin, active, and back in their edge's set. Edges are worked out when they are asked for."""
    out = restore(store, hashes)

    def edges() -> DataFrame:
        rel = out["relation"].join(hashes.select("hash"), "hash", "left_semi")
        back = _ends(rel).groupBy("src", "dst").agg(F.collect_set("hash").alias("_h"))
        j = out["edge"].join(back, ["src", "dst"], "full_outer")
        empty = F.array().cast("array<string>")
        sets = F.array_sort(F.array_union(F.coalesce("relation_hashes", empty), F.coalesce("_h", empty)))
        grown = F.when(F.col("_h").isNotNull() & (F.coalesce("weight", F.lit(0.0)) <= 0), weight).otherwise(F.col("weight"))
        return j.select("src", "dst", grown.alias("weight"), F.when(F.col("_h").isNotNull(), sets).otherwise(F.col("relation_hashes")).alias("relation_hashes"))

    return Tables() | out | {"relation": set_active(out["relation"], hashes, True, 0.0), "edge": edges}


def relations_of_edge(edges: DataFrame, edge_id: str) -> DataFrame:
    """The hashes of an edge given as source_target, split at the first underscore."""
    s, _, t = edge_id.partition("_")
    return edges.where((F.col("src") == s.strip().lower()) & (F.col("dst") == t.strip().lower())).select(F.explode("relation_hashes").alias("hash"))
