"""Adaptive score thresholds and result filters."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Threshold

def per_query():
    return Window.partitionBy("query_id")


def thresholds(results: DataFrame, config: Threshold = Threshold()) -> DataFrame:
    """Per query the percentile, mean minus sigmas, and gap thresholds, and their clipped median.

    gap: the score after the smallest drop in descending order (gap_mode="largest": after the largest), ties: the first.
    """
    w = per_query().orderBy(F.desc("score"), "hash")
    gaps = results.select("query_id", "score", (F.lag("score").over(w) - F.col("score")).alias("drop"), F.row_number().over(w).alias("r"))
    sign = 1 if config.gap_mode == "smallest" else -1
    gap = F.min_by("score", F.when(F.col("drop").isNotNull(), F.struct((F.col("drop") * sign).alias("d"), "r")))
    g = gaps.groupBy("query_id").agg(
        F.percentile("score", F.lit(config.percentile / 100)).alias("by_percentile"),
        (F.avg("score") - config.sigma * F.stddev_pop("score")).alias("by_deviation"),
        F.coalesce(gap, F.max("score")).alias("by_gap"),
    )
    median = F.array_sort(F.array("by_percentile", "by_deviation", "by_gap"))[1]
    return g.withColumn("threshold", F.least(F.greatest(median, F.lit(config.low)), F.lit(config.high)))


def adaptive(results: DataFrame, config: Threshold = Threshold()) -> DataFrame:
    """What reaches the threshold, and at least the best min_results."""
    t = thresholds(results, config).select("query_id", "threshold")
    n = F.row_number().over(per_query().orderBy(F.desc("score"), "hash"))
    j = results.join(t, "query_id").withColumn("_n", n)
    enough = F.sum((F.col("score") >= F.col("threshold")).cast("int")).over(per_query()) >= config.min_results
    return j.withColumn("_e", enough).where(F.when(F.col("_e"), F.col("score") >= F.col("threshold")).otherwise(F.col("_n") <= config.min_results)).drop("_n", "_e")


def adjusted(history: DataFrame, tolerance: float = 0.2, window: int = 10) -> DataFrame:
    """history(stream, at, threshold) in order: a threshold that is off the mean of the last ten adjusted ones by over 0.2 moves halfway there.

    Each value depends on those before it, so this is a fold over a stream's rows in order. Rows arrive sorted and in
    batches, and the state carried on is one stream's last ten values: a stream of any length takes constant memory.
    """
    rows = history.select("stream", "at", F.col("threshold").cast("double").alias("threshold"))

    def fold(batches):
        import pandas as pd

        stream, last = None, []
        for b in batches:
            out = []
            for s, t in zip(b["stream"], b["threshold"], strict=True):
                if (s,) != stream:
                    stream, last = (s,), []
                mean = reduce(add, last) / len(last) if last else t  # term by term: sum() compensates in some versions of Python
                t = (t + mean) / 2 if abs(t - mean) > tolerance else t
                last = [*last, t][-window:]
                out.append(t)
            yield b.assign(threshold=pd.Series(out, index=b.index, dtype=float))

    return rows.repartition("stream").sortWithinPartitions("stream", "at", "threshold").mapInPandas(fold, rows.schema)


def by_confidence(results: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Relations by their confidence, paragraphs by their score."""
    return results.where(F.when(F.col("result_type") == "relation", F.col("confidence")).otherwise(F.col("score")) >= minimum)


def diverse(results: DataFrame, k: int = 10, prefix: int = 8) -> DataFrame:
    """The best of each hash prefix, then the best k."""
    first = Window.partitionBy("query_id", F.substring("hash", 1, prefix)).orderBy(F.desc("score"), "hash")
    one = results.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return one.withColumn("rank", F.row_number().over(per_query().orderBy(F.desc("score"), "hash"))).where(F.col("rank") <= k)
