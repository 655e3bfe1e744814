"""Connected components of an edge table, as joins: smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work

MOST_ROUNDS = 200


def components(edges: DataFrame, work: Work, name: str = "cc") -> DataFrame:
    """(node, label) for each node of edges(a, b); label is the smallest node of its component. Each round is a written table."""
    both = work.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}_edges")
    now = work.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{name}_0")
    for i in range(1, MOST_ROUNDS):
        seen = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = now.join(seen, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = low.join(now.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
        nxt = work.save(jump.select("node", "was", F.least("label", F.coalesce("root", "label")).alias("label")), f"{name}_{i}")
        moved = nxt.where("label != was").limit(1).count()
        work.drop(f"{name}_{i - 1}")
        now = nxt.select("node", "label")
        if not moved:
            return now
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
