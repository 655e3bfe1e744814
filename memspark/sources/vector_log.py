"""Vectors as a merge-on-read log: a bucketed base, deltas with sequence numbers and tombstones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as vx
from ..operators import knn
from ..schemas import TABLES
from .snapshot import Snapshots, cut

ROW = TABLES["vector"] + ", seq bigint, deleted boolean"


class VectorLog:
    """The table `vector` of a snapshot root as base, and deltas beside it; a version shows one state of both.

    A write appends a delta and reads nothing. Of a hash the first vector after its last tombstone is live, so a known
    hash stays as it is until it is deleted. Deltas lie in the base's buckets; a read merges only the hashes that deltas
    name, and lets the rest of the base through as it lies. compact() rewrites the buckets that have deltas. Ids are the
    hash alone; item_type and embedding go with it.
    """

    NAME = "vector_log"

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.s = Snapshots(spark, root, buckets)
        self.spark = spark

    def _deltas(self, version: int | None = None) -> list[dict]:
        return (self.s.get(self.NAME, version) or {"deltas": []})["deltas"]

    def _append(self, rows: DataFrame, counts, note: str) -> int:
        """rows(hash, item_type, embedding, deleted) as the next delta."""
        base, commit_id = self.s.version(), uuid.uuid4().hex
        found = self.s.listing("vector") if base else None
        path = f"tables/{commit_id}/{self.NAME}"
        dealt = rows.withColumn("seq", F.lit(base + 1).cast("bigint")).select("hash", "item_type", "embedding", "seq", "deleted")
        dealt = dealt.withColumn("_bucket", self.s._bucket("vector", found["n"] if found else self.s.buckets)).hint("rebalance", "_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.s.root}/{path}")
        told = self.spark.read.schema(f"{ROW}, _bucket int").parquet(f"{self.s.root}/{path}").groupBy("_bucket").agg(counts).collect()  # a row a bucket
        new = {"path": path, "seq": base + 1, "rows": sum(r[1] for r in told), "kind": note, "buckets": sorted(r[0] for r in told)}
        deltas = [*self._deltas(), new]
        return self.s.put(self.NAME, {"deltas": deltas}, [d["path"] for d in deltas], commit_id, base, note)

    def add(self, rows: DataFrame, dim: int | None = None) -> int:
        """Valid vectors at unit length; of several rows with a hash one counts, the same in every run."""
        ok = rows.where(vx.is_valid(F.col("embedding"), dim) & F.col("hash").isNotNull())
        one = ok.groupBy("hash").agg(F.min_by(F.struct("item_type", "embedding"), F.xxhash64("item_type", "embedding")).alias("r")).select("hash", "r.*")
        unit = one.select("hash", "item_type", vx.normalize(F.col("embedding")).cast("array<float>").alias("embedding"), F.lit(False).alias("deleted"))
        return self._append(unit, F.count(F.lit(1)), "add")

    def delete(self, hashes: DataFrame) -> int:
        """Tombstones; a hash that isn't there costs a row in the log and changes nothing."""
        gone = hashes.select("hash").where("hash is not null").distinct()
        none = gone.select("hash", F.lit(None).cast("string").alias("item_type"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(True).alias("deleted"))
        return self._append(none, F.count(F.lit(1)), "delete")

    def _delta_rows(self, version: int | None, buckets: list[int] | None) -> DataFrame:
        paths = [f"{self.s.root}/{d['path']}/_bucket={b}" for d in self._deltas(version) for b in d["buckets"] if buckets is None or b in buckets]
        return self.spark.read.schema(ROW).parquet(*paths) if paths else self.spark.createDataFrame([], ROW)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The live vectors of a version, or of some of its buckets."""
        base, delta = self.s.read("vector", version, buckets), self._delta_rows(version, buckets)
        names = delta.select("hash").distinct()
        old = base.join(names, "hash", "left_semi").withColumns({"seq": F.lit(0).cast("bigint"), "deleted": F.lit(False)})
        every = old.unionByName(delta)
        last = every.where("deleted").groupBy("hash").agg(F.max("seq").alias("_gone"))
        alive = every.where("not deleted").join(last, "hash", "left").where("_gone is null or seq > _gone")
        merged = alive.groupBy("hash").agg(F.min_by(F.struct("item_type", "embedding"), "seq").alias("r")).select("hash", "r.item_type", "r.embedding")
        return base.join(names, "hash", "left_anti").unionByName(merged)

    def deleted(self) -> tuple[int, int]:
        """(rows in base and deltas, tombstones)."""
        found = self.s.listing("vector") if self.s.version() else None
        held = sum(x["rows"] for x in found["buckets"].values()) if found else 0
        count = lambda kind: sum(d["rows"] for d in self._deltas() if d["kind"] == kind)
        return held + count("add"), count("delete")

    def needs_compaction(self, most_deltas: int = 32) -> bool:
        """Over 30 % and over 1000 rows deleted, or many deltas to merge at each read."""
        return knn.needs_compaction(*self.deleted()) or len(self._deltas()) > most_deltas

    def compact(self) -> int:
        """Rewrites the buckets that have deltas as base; the log is empty after."""
        now, commit_id = self.s.version(), uuid.uuid4().hex
        touched = sorted({b for d in self._deltas(now) for b in d["buckets"]})
        if not touched:
            return now
        old = self.s.listing("vector", now)
        entry = self.s._write("vector", cut(self.read(now, touched)), commit_id, old or {"n": self.s.buckets, "buckets": {}}, touched)
        return self.s.put(self.NAME, {"deltas": []}, [], commit_id, now, "compact", {"vector": entry})
