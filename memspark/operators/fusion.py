"""Fusing and reranking ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def per_query():
    return Window.partitionBy("query_id")


def ordered(*more: Column):
    return per_query().orderBy(F.desc("score"), *more, "hash")


def minmax(df: DataFrame, column: str = "score") -> DataFrame:
    """To [0, 1] per query; a constant list is all 1."""
    lo, hi = F.min(column).over(per_query()), F.max(column).over(per_query())
    return df.withColumn(column, F.when(hi - lo < 1e-12, 1.0).otherwise((F.col(column) - lo) / (hi - lo)))


def rrf(lists: list[tuple[DataFrame, float]], k: int = 60, normalize: bool = True) -> DataFrame:
    """Sum of weight / (k + rank) over lists(query_id, hash, score); a query with one list keeps that list's scores."""
    parts = None
    for i, (df, w) in enumerate(lists):
        ranked = df.select("query_id", "hash", F.col("score").cast("double").alias("own"), F.row_number().over(ordered()).alias("r"), F.lit(i).alias("list"), F.lit(float(w)).alias("w"))
        parts = ranked if parts is None else parts.unionByName(ranked)
    one = F.min("list").over(per_query()) == F.max("list").over(per_query())
    fused = parts.withColumn("one", one).groupBy("query_id", "hash").agg(F.sum(F.col("w") / (k + F.col("r"))).alias("f"), F.max("own").alias("own"), F.first("one").alias("one"))
    mixed = fused.where("not one").select("query_id", "hash", F.col("f").alias("score"))
    alone = fused.where("one").select("query_id", "hash", F.col("own").alias("score"))
    return (minmax(mixed) if normalize else mixed).unionByName(alone)


def merge_max(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """One row per hash with the larger score, and where it came from."""
    both = dense.select("query_id", "hash", "score", F.lit("dense").alias("src")).unionByName(sparse.select("query_id", "hash", "score", F.lit("sparse").alias("src")))
    return both.groupBy("query_id", "hash").agg(F.max("score").alias("score"), F.when(F.count_distinct("src") > 1, "relation_fusion").otherwise(F.concat(F.lit("relation_"), F.first("src"))).alias("source"))


def merge_graph(dense: DataFrame, sparse: DataFrame, graph: DataFrame) -> DataFrame:
    """0.6 * best normalised score + 0.3 * graph kind + 0.1 * support; graph(query_id, hash, candidate_type, support)."""
    a = minmax(dense).select("query_id", "hash", F.col("score").alias("v"))
    b = minmax(sparse).select("query_id", "hash", F.col("score").alias("s"))
    kind = F.col("candidate_type")
    weight = F.when(kind.isin("direct_pair", "direct"), 1.0).when(kind.isin("one_hop_seed", "one_hop"), 0.75).when(kind.isin("two_hop_pair", "two_hop"), 0.55).otherwise(0.0)
    g = graph.select("query_id", "hash", weight.alias("g"), F.least(F.lit(1.0), F.coalesce("support", F.lit(0)) / 3.0).alias("u"))
    keys = ["query_id", "hash"]
    j = a.join(b, keys, "full_outer").join(g, keys, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return j.select(*keys, (0.6 * F.greatest(zero("v"), zero("s")) + 0.3 * zero("g") + 0.1 * zero("u")).alias("score"))


def fuse(paragraphs: DataFrame, relations: DataFrame, bridge: DataFrame, alpha: float | Column = 0.5, preserve: int = 0) -> DataFrame:
    """Alpha-weighted union; a relation goes if a paragraph ranked above supports it, unless it is among the first `preserve`."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    p = paragraphs.select("query_id", "hash", (F.col("score") * a).alias("score"), F.lit("paragraph").alias("result_type"), F.lit(False).alias("safe"))
    r = relations.withColumn("_n", F.row_number().over(ordered())).select("query_id", "hash", (F.col("score") * (1 - a)).alias("score"), F.lit("relation").alias("result_type"), (F.col("_n") <= preserve).alias("safe"))
    ranked = p.unionByName(r).withColumn("rank", F.row_number().over(per_query().orderBy(F.desc("score"), "result_type", "hash")))
    above = ranked.where("result_type = 'paragraph'").select("query_id", F.col("hash").alias("paragraph_hash"), F.col("rank").alias("p_rank"))
    held = bridge.join(above, "paragraph_hash").groupBy("query_id", F.col("relation_hash").alias("hash")).agg(F.min("p_rank").alias("p_rank"))
    j = ranked.join(held, ["query_id", "hash"], "left")
    kept = j.where((F.col("result_type") == "paragraph") | F.col("safe") | F.col("p_rank").isNull() | (F.col("p_rank") > F.col("rank")))
    return kept.select("query_id", "hash", "score", "result_type", F.row_number().over(per_query().orderBy("rank")).alias("rank"))


def ppr_rerank(results: DataFrame, bridge: DataFrame, entity_scores: DataFrame, weight: float = 0.3) -> DataFrame:
    """Mixes in the mean PageRank of a paragraph's scored entities; others keep their score. entity_scores(query_id, entity_hash, ppr)."""
    # The results first meet their entities: scores of an entity that a query has no paragraph of are never paired.
    linked = results.select("query_id", "hash").distinct().join(bridge.select(F.col("paragraph_hash").alias("hash"), "entity_hash"), "hash")
    mean = linked.join(entity_scores, ["query_id", "entity_hash"]).groupBy("query_id", "hash").agg(F.avg("ppr").alias("ppr"))
    j = results.join(mean, ["query_id", "hash"], "left")
    return j.withColumn("score", F.when(F.col("ppr").isNotNull(), (1 - weight) * F.col("score") + weight * F.col("ppr")).otherwise(F.col("score"))).drop("ppr")


def pair_rerank(results: DataFrame, relations: DataFrame, limit: int = 3) -> DataFrame:
    """Within the slots that relations hold, at most `limit` of a subject-object pair come before the others.

    results(query_id, hash, score, result_type, rank); pairs go in order of their best, what exceeds the limit goes last.
    """
    rel = results.where("result_type = 'relation'").join(relations.select("hash", F.lower("subject").alias("s"), F.lower("object").alias("o")), "hash")
    pair = Window.partitionBy("query_id", "s", "o")
    rel = rel.withColumns({"n": F.row_number().over(pair.orderBy("rank")), "best": F.min("rank").over(pair)})
    rel = rel.withColumn("slot", F.row_number().over(per_query().orderBy((F.col("n") > limit).cast("int"), F.when(F.col("n") <= limit, F.col("best")), "rank")))
    slots = results.where("result_type = 'relation'").select("query_id", F.col("rank").alias("new_rank"), F.row_number().over(per_query().orderBy("rank")).alias("slot"))
    moved = rel.join(slots, ["query_id", "slot"]).select("query_id", "hash", "score", "result_type", F.col("new_rank").alias("rank"))
    return results.where("result_type != 'relation'").select("query_id", "hash", "score", "result_type", "rank").unionByName(moved)


def temporal_sort(results: DataFrame, k: int | None = None) -> DataFrame:
    """By score, then by the latest effective end (or start); without time last."""
    when = F.coalesce("effective_end", "effective_start")
    ranked = results.withColumn("rank", F.row_number().over(per_query().orderBy(F.desc("score"), when.desc_nulls_last(), "hash")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def relation_intent(queries: DataFrame, top_k: int = 10, relation_k: int = 10, alpha: float = 0.35, multiplier: int = 4, preserve: int = 3, pair_limit: int = 3) -> DataFrame:
    """Adds what a query that asks for a relation changes."""
    # Fixed value: words that ask for a relation.
    asks = r"(?i)什么关系|有哪些关系|和.+关系|关联|关系网|subject|predicate|object|relation|related|between.+and"
    t = F.trim(F.coalesce("text", F.lit("")))
    on = t.contains("|") | t.contains("->") | t.rlike(asks)
    base = max(1, relation_k, top_k)
    return queries.withColumns({"relation_intent": on, "alpha": F.when(on, alpha), "relation_top_k": F.when(on, base * multiplier).otherwise(base), "preserve": F.when(on, preserve).otherwise(0), "force_sparse": on, "pair_limit": F.when(on, pair_limit).otherwise(0)})


def content_dedup(results: DataFrame, k: int = 50) -> DataFrame:
    """In rank order a result goes if its content contains, or is contained in, that of a result already kept.

    Empty content goes, but the first stays if all are empty. Only the first k of a query are looked at and returned: a
    fold over them.
    """
    top = results.withColumn("_r", F.row_number().over(per_query().orderBy("rank", "hash"))).where(F.col("_r") <= k)
    text = F.trim(F.coalesce("content", F.lit("")))
    items = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("_r").alias("r"), "hash", text.alias("c")))).alias("items"))
    empty = F.array().cast("array<struct<r:int,hash:string,c:string>>")
    kept = F.aggregate("items", empty, lambda acc, x: F.when((x["c"] == "") | F.exists(acc, lambda y: y["c"].contains(x["c"]) | x["c"].contains(y["c"])), acc).otherwise(F.concat(acc, F.array(x))))
    final = F.when(F.size(kept) > 0, kept).otherwise(F.slice("items", 1, 1))
    chosen = items.select("query_id", F.explode(final).alias("x")).select("query_id", F.col("x.hash").alias("hash"))
    return results.join(chosen, ["query_id", "hash"], "left_semi")


def with_paths(results: DataFrame, paths: DataFrame, threshold: float = 0.6, score: float = 0.95) -> DataFrame:
    """Queries whose best result is below the threshold get path results (query_id, hash, content) in front."""
    best = results.groupBy("query_id").agg(F.max("score").alias("best"))
    low = paths.select("query_id").distinct().join(best, "query_id", "left").where(F.coalesce(F.col("best") < threshold, F.lit(True))).select("query_id")
    extra = paths.join(low, "query_id", "left_semi").select("query_id", "hash", F.lit(score).alias("score"), F.lit("path").alias("result_type"), F.lit(0).alias("_p"))
    both = extra.unionByName(results.select("query_id", "hash", "score", "result_type", F.lit(1).alias("_p")))
    return both.withColumn("rank", F.row_number().over(per_query().orderBy("_p", F.desc("score"), "hash"))).drop("_p")


def path_bonus(results: DataFrame, relations: DataFrame, support: DataFrame) -> DataFrame:
    """Up to 0.08 more for relations on found paths, 0.04 for each path; support(a, b, n) of undirected pairs."""
    s, o = F.lower(F.trim("subject")), F.lower(F.trim("object"))
    pair = relations.select("hash", F.least(s, o).alias("a"), F.greatest(s, o).alias("b"))
    j = results.join(pair.join(support, ["a", "b"]).select("hash", "n"), "hash", "left")
    return j.withColumn("score", F.col("score") + F.least(F.lit(0.08), 0.04 * F.coalesce("n", F.lit(0)))).drop("n")
