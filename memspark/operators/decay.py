"""Weights that decay by time and are worked out when they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.snapshot import Snapshots, cut

HOUR = 3600.0


def weight_at(now: float, half_life_h: float) -> Column:
    """The weight at `now` of a row with weight and since."""
    return F.col("weight") * F.pow(F.lit(0.5), (F.lit(float(now)) - F.col("since")) / (half_life_h * HOUR))


class DecayingEdges:
    """Edges (src, dst, weight, since) of a snapshot root, whose weight halves every half_life_h hours, and their relation_hashes.

    Nothing is rewritten for time that passes. A table of due hours, dealt by hour, tells when each edge falls below
    `below`: a tick reads the hours since the last one, freezes those edges that have really fallen (weight 0), and
    writes the buckets of these alone, where they lie. An edge that was strengthened meanwhile is due later; its old row is
    passed over and goes with the tick that meets it. Frozen edges have no due hour. Sets of hashes, which are wider than
    all else, are a table of their own that ticks and shifts leave alone.
    """

    def __init__(self, snapshots: Snapshots, half_life_h: float = 24.0, below: float = 0.1):
        self.s, self.half, self.below = snapshots, half_life_h, below

    def _hour(self) -> Column:
        """The first whole hour after a live edge falls below."""
        at = F.col("since") + F.log2(F.col("weight") / F.lit(self.below)) * (self.half * HOUR)
        return (F.floor(F.greatest(at, "since") / HOUR) + 1).cast("bigint")

    def _due(self, edges: DataFrame) -> DataFrame:
        """(hour, src, dst) at which each live edge is below."""
        return edges.where("weight > 0").select(self._hour().alias("hour"), "src", "dst")

    def put(self, edges: DataFrame, now: float) -> int:
        """Adds edges (src, dst, weight, relation_hashes), or sets them, as of `now`."""
        rows = self.s.one_each("edge_state", edges.select("src", "dst", F.col("weight").cast("double").alias("weight"), F.lit(float(now)).alias("since"), "relation_hashes"))
        tables = {"edge_state": rows.drop("relation_hashes"), "edge_set": rows.select("src", "dst", "relation_hashes"), "edge_due": self._due(rows)}
        return self.s.change(tables, note="put edges", settled=tuple(tables))

    def weights(self, now: float) -> DataFrame:
        """(src, dst, weight) of all edges at `now`."""
        return self.s.read("edge_state").select("src", "dst", weight_at(now, self.half).alias("weight"))

    def read(self, now: float) -> DataFrame:
        """All edges with their weight at `now` and their relation_hashes."""
        return self.weights(now).join(self.s.read("edge_set"), ["src", "dst"], "left").select("src", "dst", "weight", "relation_hashes")

    def shift(self, changes: DataFrame, now: float, low: float = 0.1, high: float = 10.0) -> int:
        """changes(src, dst, delta) on the weights at `now`, within bounds; only the buckets of these edges are read and written."""
        version = self.s.version()
        total = cut(changes.groupBy("src", "dst").agg(F.sum("delta").alias("delta"), F.lit(True).alias("_hit")))
        buckets = self.s.buckets_of("edge_state", total, version)
        moved = F.least(F.greatest(weight_at(now, self.half) + F.col("delta"), F.lit(low)), F.lit(high))
        hit = F.col("_hit").isNotNull()
        held = self.s.read("edge_state", version, buckets).join(total, ["src", "dst"], "left")
        rows = cut(held.select("src", "dst", F.when(hit, moved).otherwise(F.col("weight")).alias("weight"), F.when(hit, F.lit(float(now))).otherwise(F.col("since")).alias("since"), hit.alias("_hit")))
        return self.s.change({"edge_due": self._due(rows.where("_hit"))}, note="shift edges", expected=version, settled=("edge_due",), whole={"edge_state": (rows.drop("_hit"), buckets)})

    def tick(self, last: float, now: float) -> tuple[DataFrame, int]:
        """(src, dst) of the edges that fell below since the tick at `last`, now frozen; and the version."""
        version, (first, end) = self.s.version(), (int(last // HOUR), int(now // HOUR))
        hours = self.s.spark.range(first, end + 1).select(F.col("id").alias("hour"))
        due = self.s.read("edge_due", version, self.s.buckets_of("edge_due", hours, version)).where(F.col("hour").between(first, end)).select("src", "dst", "hour")
        buckets = self.s.buckets_of("edge_state", due, version)
        if not buckets:
            return due.select("src", "dst"), version
        # An edge's row tells its hour; the due rows have told where to look.
        held = self.s.read("edge_state", version, buckets)
        down = F.coalesce((F.col("weight") > 0) & self._hour().between(first, end) & (weight_at(now, self.half) < self.below), F.lit(False))
        fallen = cut(held.where(down).select("src", "dst"))
        rows = held.select("src", "dst", F.when(down, 0.0).otherwise(F.col("weight")).alias("weight"), F.when(down, F.lit(float(now))).otherwise(F.col("since")).alias("since"))
        return fallen, self.s.change(deletes={"edge_due": hours}, note="tick", expected=version, whole={"edge_state": (rows, buckets)}, placed=("edge_state", "edge_due"))
