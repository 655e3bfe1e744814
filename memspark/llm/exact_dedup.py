"""Exact dedup as a stateful stream: keyed state on disk, never expired, holds digest, stable id and content locator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, settings

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of groups larger than this are not broadcast but joined by a shuffle.
BROADCAST_ROWS = 250_000


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the short way, where lower() is the same."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def digest(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_per_batch: int = 256 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays; a null id sorts below all others, and of rows repeated with the same id one stays. An empty
    table gives no rows; further columns are ignored.

    The normalised texts are written once, content-addressed by digest. A stream reads that table's keys in
    micro-batches of `bytes_per_batch` and keeps per digest the largest (id, locator) and the count in RocksDB state
    without expiry, checkpointed in the shared folder. Each digest hit is then checked over the full bytes; should
    two texts share a digest, those digests are grouped by their bytes instead.
    """
    spark = docs.sparkSession
    work = Work(spark, "exact")
    body = F.coalesce(ascii_lower(F.col(text_col)), F.lit(""))
    base = work.save(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body")).select("doc_id", digest(F.col("body")).alias("digest"), F.monotonically_increasing_id().alias("locator"), "body"),
        "base",
    )
    keeper = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "locator")
    with settings(
        spark,
        spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
        spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="256",
        spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true",
        spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",
    ):
        state = spark.readStream.schema(base.schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(work.path("base")).groupBy("digest").agg(F.max(keeper).alias("keeper"), F.count(F.lit(1)).alias("n"))
        out = work.path("state")
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", work.path("stream"))
            .trigger(availableNow=True)
            .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
            .start()
        )
        query.awaitTermination()
        if query.exception():
            raise RuntimeError(str(query.exception()))
    work.drop("stream")
    schema = "digest binary, keeper struct<known:boolean,doc_id:bigint,locator:bigint>, n bigint, batch int"
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{out}/batch=-1")
    # Keeper and count only grow, so the largest is the state after the last batch.
    groups = work.save(spark.read.schema(schema).parquet(out).groupBy("digest").agg(F.max("keeper").alias("keeper"), F.max("n").alias("n")), "groups")
    work.drop("state")
    hits = groups.where("n > 1").select("digest")
    small = hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # Partial minima and maxima leave one row of a group for each task, however large the group.
    same = base.select("digest", "body").join(F.broadcast(hits) if small else hits, "digest", "left_semi").groupBy("digest").agg(F.min("body").alias("lo"), F.max("body").alias("hi"))
    mixed = work.save(same.where("lo != hi").select("digest"), "mixed")
    rows = base.select("doc_id", "locator", "digest")
    if not mixed.isEmpty():  # two texts with one SHA-256: group these by their bytes
        odd = base.join(mixed, "digest", "left_semi")
        split = odd.groupBy("digest", "body").agg(F.max(keeper).alias("keeper"), F.count(F.lit(1)).alias("n"))
        joined = rows.join(mixed, "digest", "left_anti").join(groups, "digest").unionByName(odd.join(split, ["digest", "body"]).drop("body"))
    else:
        joined = rows.join(groups, "digest")
    return joined.select(
        "doc_id",
        F.col("keeper.doc_id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("locator") == F.col("keeper.locator")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
