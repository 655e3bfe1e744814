"""Exact batched nearest neighbours and vector upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as vx
from . import intervals, matrix


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, item_type: str | None = None, dim: int | None = None) -> DataFrame:
    """vectors(hash, item_type, embedding) x queries(query_id, embedding) to the k best per query.

    Cosine similarity in double precision; invalid vectors and queries are left out; ties go to the smaller hash. The
    vectors are read once, whatever the number of queries, and packed where they lie; each pair of blocks is one matrix
    product that keeps its own k best before the merge.
    """
    v = vectors if item_type is None else vectors.where(F.col("item_type") == item_type)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "hash")
    return matrix.nearest(v, queries, k, dim).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search_within(vectors: DataFrame, queries: DataFrame, paragraphs: DataFrame, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """The k best of each query among the paragraphs of its own window, source and person, in one pass over the vectors.

    queries have lower, upper, source and person (intervals.with_limits). Without a person the limits are masks of the
    blocks' products; queries with one score the pairs in `allowed` (query_id, hash) alone.
    """
    v = vectors.select("hash", "embedding").join(intervals.spans(paragraphs), "hash")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "hash")
    found = matrix.nearest(v, queries.where("person is null"), k, windowed=True)
    if allowed is not None:
        own = intervals.within(allowed, queries, paragraphs, allowed)
        rows = own.join(queries.select("query_id", F.col("embedding").alias("a")), "query_id").join(vectors.select("hash", F.col("embedding").alias("b")), "hash")
        found = found.unionByName(matrix.scored(rows, ("query_id", "hash")))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def add(existing: DataFrame, incoming: DataFrame, dim: int) -> DataFrame:
    """Valid new vectors, normalised; known hashes stay as they are."""
    new = incoming.where(vx.is_valid(F.col("embedding"), dim)).dropDuplicates(["hash"]).join(existing.select("hash"), "hash", "left_anti")
    return existing.unionByName(new.withColumn("embedding", vx.normalize(F.col("embedding")).cast("array<float>")).select(*existing.columns))


def delete(vectors: DataFrame, hashes: DataFrame) -> DataFrame:
    """R03"""
    return vectors.join(hashes.select("hash"), "hash", "left_anti")


def needs_compaction(total: int, deleted: int) -> bool:
    """Over 30 % and over 1000 rows deleted."""
    return deleted > 1000 and total > 0 and deleted / total > 0.3


def training_sample(vectors: DataFrame, n: int = 10_000, seed: int = 42) -> DataFrame:
    """N rows chosen by a hash of their key, the same in every run."""
    return vectors.orderBy(F.xxhash64(F.lit(seed), "hash"), "hash").limit(n)


def lsh_search(vectors: DataFrame, queries: DataFrame, k: int = 10, planes: int = 6, tables: int = 12, seed: int = 5, probes: int = 4) -> DataFrame:
    """Approximate search: signs against `planes` fixed hyperplanes give a bucket in each of `tables` tables; candidates are scored exactly.

    A query also looks into the `probes` buckets across the hyperplanes that it is nearest to, one crossed at a time.
    """
    def margin(v, plane: int):
        """How far, and on which side of, a fixed hyperplane the vector is."""
        part = lambda x, i: x * (F.pmod(F.xxhash64(F.lit(seed), F.lit(plane), i), F.lit(2001)) - 1000) / 1000.0
        return F.aggregate(F.transform(v, part), F.lit(0.0), lambda s, x: s + x)

    def coded(df: DataFrame, name: str, probes: int = 0) -> DataFrame:
        unit = df.where(vx.is_valid(F.col("embedding"))).withColumn(name, vx.normalize(F.col("embedding"))).drop("embedding")
        table = lambda t: F.struct(F.lit(t).alias("t"), F.array(*[F.struct(margin(F.col(name), t * planes + p).alias("m"), F.lit(1 << (planes - 1 - p)).alias("bit")) for p in range(planes)]).alias("sides"))
        sides = unit.select("*", F.inline(F.array(*[table(t) for t in range(tables)])))
        base = F.aggregate("sides", F.lit(0), lambda s, x: s + F.when(x["m"] >= 0, x["bit"]).otherwise(0))
        near = F.slice(F.array_sort(F.transform("sides", lambda x: F.struct(F.abs(x["m"]).alias("m"), x["bit"].alias("bit")))), 1, probes)
        every = F.concat(F.array("b"), F.transform(near, lambda x: F.col("b").bitwiseXOR(x["bit"])))
        return sides.withColumn("b", base).withColumn("b", F.explode(every)).drop("sides")

    q, v = coded(queries.select("query_id", "embedding"), "_q", probes), coded(vectors.select("hash", "embedding"), "_v")
    pairs = q.join(v, ["t", "b"]).select("query_id", "hash", vx.dot(F.col("_q"), F.col("_v")).alias("score")).dropDuplicates(["query_id", "hash"])
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "hash"))).where(F.col("rank") <= k)


def scan_k(k: int, temporal: bool, multiplier: int = 8, max_scan: int = 1000) -> int:
    """How many candidates a time-bound search takes."""
    return max(1, min(k * multiplier, max_scan) if temporal else k)
