"""Quality: importance resampling by the ratio of hashed n-gram models of target and raw text, by Gumbel top-k."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, mix64, pieces, texts_of
from .shingles import words

BUCKETS = 1 << 14
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Keys that are sorted at once when the top-k threshold has been narrowed down to them.
LAST = 20_000


def ngrams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every word and every pair of neighbouring words."""
    w, begin = words(*texts_of(batch, "text"))
    doc = np.repeat(np.arange(batch.num_rows), np.diff(begin))
    pair = mix64(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]) if len(w) > 1 else np.zeros(0, np.uint64)
    same = doc[1:] == doc[:-1]
    size = np.uint64(BUCKETS)
    return np.concatenate([doc, doc[1:][same]]), np.concatenate([w % size, pair[same] % size]).astype(np.int64)


def log_ratio(slim: DataFrame, work: Work) -> np.ndarray:
    """log p_target / p_raw of each bucket, from the counts of all texts; slim: text, target (0 or 1)."""

    def count(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for p in pieces(batches, "text", 1 << 20):
            doc, bucket = ngrams(p)
            target = p.column(p.schema.get_field_index("target")).to_numpy(zero_copy_only=False).astype(bool)
            raw += np.bincount(bucket, minlength=BUCKETS)
            good += np.bincount(bucket[target[doc]], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(good[used])], names=["bucket", "raw", "good"])

    found = slim.mapInArrow(count, "bucket bigint, raw bigint, good bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in found.collect():  # BUCKETS rows at most
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    if not good.any():
        return np.zeros(BUCKETS)
    return np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def top(keys: DataFrame, k: int) -> Column:
    """The condition that holds for the k rows with the largest (key, doc_id), found by narrowing histograms."""
    n = keys.count()
    if k >= n:
        return F.lit(True)
    if k <= 0:
        return F.lit(False)
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above, width = 0, 2048
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        left = inside.count()
        if left <= LAST or low == high:
            last = inside.orderBy(F.desc("key"), F.desc_nulls_last("doc_id")).limit(k - above).agg(F.min(F.struct("key", "doc_id")).alias("m")).first()["m"] if left <= LAST else None
            if last is None:  # one key for very many rows: the ids decide
                return (F.col("key") > high) | (F.col("key") == high) & _by_id(inside.select("doc_id"), k - above)
            if last["doc_id"] is None:
                return F.col("key") >= last["key"]
            return (F.col("key") > last["key"]) | (F.col("key") == last["key"]) & (F.col("doc_id") >= last["doc_id"])
        step = (high - low) / width
        part = F.least(F.lit(width - 1), F.floor((F.col("key") - low) / step))
        counts = dict(inside.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).select("p", F.struct("n", "low", "high")).collect())
        for p in sorted(counts, reverse=True):
            if above + counts[p]["n"] >= k:
                low, high = counts[p]["low"], counts[p]["high"]
                break
            above += counts[p]["n"]


def _by_id(ids: DataFrame, k: int) -> Column:
    """The condition that holds for the k largest ids and what equals the last of them, null being the smallest. Whole numbers throughout."""
    low, high, known = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    if k > known:
        return F.lit(True)
    above, width = 0, 2048
    while low < high:
        whole = lambda x: F.lit(x).cast("decimal(38,0)")
        inside = ids.where((F.col("doc_id") >= low) & (F.col("doc_id") <= high))
        part = F.floor((F.col("doc_id").cast("decimal(38,0)") - whole(low)) / whole(-(-(high - low + 1) // width)))
        counts = inside.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()  # `width` rows at most
        for r in sorted(counts, key=lambda r: -r["p"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    return F.coalesce(F.col("doc_id") >= low, F.lit(False))


def resample(docs: DataFrame, target_ids: DataFrame, fraction: float, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_grams, log_weight, key, kept.

    Both models count the hashed words and word pairs of whole texts: the raw model those of all rows, the target model
    those of the rows whose id is in target_ids(doc_id). A text's log weight is the sum of the log ratios of its n-grams;
    key adds Gumbel noise from a hash of the id; the ceil(fraction * rows) largest keys (ties: largest ids) are kept,
    which samples without replacement in proportion to the weights. Null and empty texts have weight 1. Rows repeated
    with one id share the noise. Without targets all weights are 1. Texts count whole, however long. An empty table gives
    no rows; further columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    work = Work(spark, "quality")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = work.save(target_ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("target")).where("doc_id is not null").distinct(), "ids")
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    marked = slim.join(F.broadcast(ids) if small else ids, "doc_id", "left").select("text", F.coalesce("target", F.lit(0)).alias("target"))
    ratio = log_ratio(marked, work)
    sent = spark.sparkContext.broadcast(ratio)

    def weigh(batches):
        for p in pieces(batches, "text", 1 << 20):
            doc, bucket = ngrams(p)
            z = np.bincount(doc, weights=sent.value[bucket], minlength=p.num_rows)
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(np.bincount(doc, minlength=p.num_rows)), pa.array(z)], names=["doc_id", "n_grams", "log_weight"])

    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 12) + F.lit(0.5)) / float(1 << 52)
    gumbel = -F.log(-F.log(uniform))
    keys = work.save(slim.mapInArrow(weigh, "doc_id bigint, n_grams bigint, log_weight double").withColumn("key", F.col("log_weight") + gumbel), "keys")
    return keys.withColumn("kept", top(keys, math.ceil(fraction * keys.count())))


def quality(docs: DataFrame, labels: DataFrame, fraction: float | None = None) -> DataFrame:
    """resample() towards the rows labelled quality = 1. By default as large a share is kept as the labels call good.

    Null labels and ids count for nothing; without labels nothing is kept. Null, empty and very long texts, ties,
    repeated rows, empty tables and further columns are dealt with as resample() does.
    """
    if fraction is None:
        fraction = labels.where("quality is not null").agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0] or 0.0
    return resample(docs, labels.where("quality = 1").select("doc_id"), fraction)
