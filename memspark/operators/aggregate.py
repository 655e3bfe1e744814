"""Aggregate queries over several branches (R35, X12) and request keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mix_key() -> Column:
    """Type:hash; episodes by their id."""
    return F.concat_ws(":", "result_type", "hash")


def mix(branches: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = 5, rrf_k: int = 60) -> DataFrame:
    """branches(query_id, hash, result_type, rank) by weighted reciprocal rank, with the branches each item came from."""
    parts = None
    for name, df in branches.items():
        w = max(0.0, (weights or {}).get(name, 1.0))
        p = df.select("query_id", mix_key().alias("key"), "hash", "result_type", F.lit(name).alias("branch"), (F.lit(w) / (rrf_k + F.col("rank"))).alias("part"))
        parts = p if parts is None else parts.unionByName(p)
    g = parts.groupBy("query_id", "key").agg(F.first("hash").alias("hash"), F.first("result_type").alias("result_type"), F.sum("part").alias("score"), F.array_sort(F.collect_set("branch")).alias("source_branches"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def summary(branches: dict[str, DataFrame]) -> DataFrame:
    """Results of each branch."""
    parts = None
    for name, df in branches.items():
        p = df.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).select("query_id", F.lit(name).alias("branch"), "n")
        parts = p if parts is None else parts.unionByName(p)
    return parts


def request_key(*columns: Column) -> Column:
    """sha1 of the request as JSON, fields in order."""
    return F.sha1(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
