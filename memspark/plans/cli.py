"""Batch entry points over a snapshot root, for spark-submit.

    spark-submit --py-files memspark.zip memspark/plans/cli.py ROOT sources | delete-source NAME | rebuild-episodes [SOURCE...] | backfill-times | backfill-vectors |
        import-files PATH | import-json PATH [REJECTED [MOST_REJECTED]] | maintain [HITS] | audit

import-json writes documents of no known shape to REJECTED, and stops before anything is committed if there are more than
MOST_REJECTED. HITS is a table of relation hashes that were used since the last run, as streaming.jobs.reinforce_buffer
makes it. Imports rewrite only the buckets that their
rows lie in, other commands the tables that they change; a commit fails if another came between. Executors need the package:
--py-files memspark.zip.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as tx
from memspark.operators import catalog, chunk, dml, graph, hooks, joins, lifecycle
from memspark.sources import ingest, readers
from memspark.sources.snapshot import Snapshots, cut
from memspark.streaming import jobs


def import_files(s: Snapshots, files: DataFrame, now: float) -> int:
    """Whole files: chunked by their own strategy, names and relations by pattern where the type has any."""
    f = files.select("content", "path", tx.import_strategy(F.col("content")).alias("strategy"))
    c = chunk.rescue(chunk.split(f)).where(tx.strip(F.col("text")) != "").select("path", "idx", F.col("text").alias("content")).withColumn("hash", tx.content_hash(tx.normalize(F.col("content"))))
    c = c.withColumn("knowledge_type", tx.knowledge_type(F.col("content")))
    e, r = ingest.extract_regex(c.where(tx.extracts_relations(F.col("knowledge_type"))).dropDuplicates(["hash"]))
    names = e.groupBy("hash").agg(F.array_sort(F.collect_set("name")).alias("entities"))  # one chunk's names
    rel = r.groupBy("hash").agg(F.collect_list(F.struct("subject", "predicate", "object")).alias("relations"))
    items = c.join(names, "hash", "left").join(rel, "hash", "left").select("content", "knowledge_type", F.col("path").alias("source"), F.xxhash64("path", "idx").alias("ord"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), F.coalesce("relations", F.array().cast("array<struct<subject:string,predicate:string,object:string>>")).alias("relations"))
    items = cut(items)
    touched = ingest.touched(s, items)
    return publish(s, pruned(s, touched), lambda store: ingest.persist(store, items, now), touched, "files")


def import_json(s: Snapshots, files: DataFrame, now: float, rejected: str | None = None, most: int | None = None) -> int:
    """JSON documents of any known shape; the others are rejected."""
    bad = files.where(ingest.json_shape(F.col("content")) == "unknown")
    if rejected is not None:
        bad.write.mode("append").parquet(rejected)
    if most is not None and bad.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} documents are of no known shape")
    u = ingest.json_units(files.select("path", F.col("content").alias("raw")))
    p = u["paragraphs"].withColumn("ord", F.xxhash64("path", "ord"))
    if "time" in p.columns:
        p = p.select("*", "time.event_time", "time.event_time_start", "time.event_time_end", "time.time_granularity", "time.time_confidence").drop("time")
    items, names, more = cut(p.drop("path")), u["entities"].select("name", F.lit(0).cast("bigint").alias("ord")), u["relations"]
    ends = names.select("name")
    touched = ingest.touched(s, items)
    extra = {"entity": ends.select(tx.entity_hash(F.col("name")).alias("hash")), "relation": more.select(tx.relation_hash(F.col("subject"), F.col("predicate"), F.col("object")).alias("hash"))}
    touched |= {t: sorted({*touched[t], *s.buckets_of(t, k)}) for t, k in extra.items()}

    def persist(store: dict[str, DataFrame]) -> dict[str, DataFrame]:
        out = ingest.persist(store, items, now)
        out["entity"] = dml.merge_entities(out["entity"], names, now)
        out["relation"] = dml.insert_relations(out["relation"], more.withColumns({"ord": F.lit(0), "confidence": F.lit(1.0), "created_at": F.lit(now)}))
        return out

    return publish(s, pruned(s, touched), persist, touched, "json")


def pruned(s: Snapshots, touched: dict[str, list[int]]) -> dict[str, DataFrame]:
    """The touched buckets of each table."""
    return {t: s.read(t, buckets=b) for t, b in touched.items()}


def publish(s: Snapshots, store: dict[str, DataFrame], persist, touched: dict[str, list[int]], note: str) -> int:
    """One snapshot of what ingest changes, in the buckets it touches, with the edges and nodes of what is new."""
    base = s.version()
    out = {t: cut(df) for t, df in persist(store).items() if t in touched}
    rel = out["relation"].join(store["relation"].select("hash"), "hash", "left_anti")
    pairs = cut(graph.build_edges(rel.select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.lit(1.0).alias("weight"), "hash", F.lit(0).alias("ord"))))
    touched = touched | {"edge": s.buckets_of("edge", pairs)}
    old = s.read("edge", buckets=touched["edge"]).withColumnsRenamed({"weight": "_w", "relation_hashes": "_h"})
    none = F.array().cast("array<string>")
    edge = old.join(pairs, ["src", "dst"], "full").select("src", "dst", F.coalesce("_w", "weight").alias("weight"), F.array_sort(F.array_union(F.coalesce("_h", none), F.coalesce("relation_hashes", none))).alias("relation_hashes"))
    nodes = cut(graph.build_nodes(out["entity"].select("name", F.lit(0).alias("ord"))))
    touched = touched | {"node": s.buckets_of("node", nodes)}
    known = s.read("node", buckets=touched["node"])
    node = known.unionByName(nodes.join(known.select("canon"), "canon", "left_anti"))
    return s.commit(out | {"edge": edge, "node": node}, note, base, touched)


def changed(store: dict[str, DataFrame], out: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that are not those of the store."""
    return {name: df for name, df in out.items() if df is not store.get(name)}


def run(spark: SparkSession, root: str, command: str, rest: list[str], now: float | None = None):
    """Runs a command; returns a frame, or the new version."""
    s, now = Snapshots(spark, root), now or time.time()
    store = s.store()
    if command == "sources":
        return catalog.sources(store["paragraph"])
    if command == "audit":
        return joins.audit(store["vector"], store["paragraph"], store["entity"], store["relation"])
    if command == "delete-source":
        return s.commit(changed(store, dml.delete_source(store, rest[0])), f"delete {rest[0]}")
    if command == "rebuild-episodes":
        p = store["paragraph"].select("source")
        jobs.rebuild_episodes(s, lambda: now)(p.where(F.col("source").isin(*rest)) if rest else p, 0)
        return s.version()
    if command == "backfill-times":
        return s.commit({"paragraph": dml.backfill_times(store["paragraph"])}, command)
    if command == "backfill-vectors":
        rel, vec = dml.add_missing_vectors(store["relation"], store["vector"], readers.hashing_embedder(), now)
        return s.commit({"relation": rel, "vector": vec}, command)
    if command in ("import-files", "import-json"):
        files = readers.text_files(spark, rest[0], extensions=(".json",) if command == "import-json" else (".txt", ".md"))
        if command == "import-json":
            return import_json(s, files, now, *rest[1:2], *map(int, rest[2:3]))
        return import_files(s, files, now)
    if command == "maintain":
        hits = spark.read.parquet(rest[0]).select("hash") if rest else store["relation"].limit(0).select("hash")
        return s.commit(changed(store, lifecycle.maintain(store, hits, now)), command)
    if command == "check":
        return hooks.self_check(store["vector"], int(rest[0]))
    raise ValueError(f"unknown command {command}")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("root")
    parser.add_argument("command")
    parser.add_argument("rest", nargs="*")
    a = parser.parse_args()
    out = run(SparkSession.builder.getOrCreate(), a.root, a.command, a.rest)
    print(out) if isinstance(out, int) else out.show(100, truncate=False)


if __name__ == "__main__":
    main()
