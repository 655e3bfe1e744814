"""Graph operators over edges(src, dst, weight, relation_hashes) and nodes(canon, name)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.snapshot import cut
from . import matcher

ACTIVE = "weight > 0"


def build_nodes(names: DataFrame) -> DataFrame:
    """names(name, ord): one node for each canonical name, with its first spelling."""
    return names.withColumn("canon", tx.canonical(F.col("name"))).where("canon != ''").groupBy("canon").agg(F.min_by("name", "ord").alias("name"))


def build_edges(pairs: DataFrame, mode: str = "sum") -> DataFrame:
    """pairs(src, dst, weight, hash, ord): weights add up (sum) or the last one counts (last)."""
    p = pairs.withColumns({"src": tx.canonical(F.col("src")), "dst": tx.canonical(F.col("dst"))})
    weight = F.sum("weight") if mode == "sum" else F.max_by("weight", "ord")
    return p.groupBy("src", "dst").agg(weight.alias("weight"), F.array_sort(F.array_compact(F.collect_set("hash"))).alias("relation_hashes"))


def shift_weights(edges: DataFrame, changes: DataFrame, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """changes(src, dst, delta): within bounds; several changes of an edge add up; a missing edge comes to be by a positive change only."""
    total = changes.groupBy("src", "dst").agg(F.sum("delta").alias("delta"))
    j = edges.join(total, ["src", "dst"], "full_outer")
    moved = F.least(F.greatest(F.coalesce("weight", F.lit(0.0)) + F.col("delta"), F.lit(low)), F.lit(high))
    kept = j.where(F.col("weight").isNotNull() | (F.col("delta") > 0))
    return kept.select("src", "dst", F.when(F.col("delta").isNotNull(), moved).otherwise(F.col("weight")).alias("weight"), F.coalesce("relation_hashes", F.array().cast("array<string>")).alias("relation_hashes"))


def delete_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """G03"""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("canon").alias(end)), end, "left_anti")
    return edges.select("src", "dst", "weight", "relation_hashes")


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """G03"""
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def deactivate(edges: DataFrame, frozen: DataFrame) -> DataFrame:
    """Weight 0, hashes stay."""
    j = edges.join(frozen.select("src", "dst", F.lit(True).alias("_f")), ["src", "dst"], "left")
    return j.withColumn("weight", F.when(F.col("_f"), 0.0).otherwise(F.col("weight"))).select("src", "dst", "weight", "relation_hashes")


def neighbors(edges: DataFrame, node: str, incoming: bool = False) -> DataFrame:
    """G04"""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    return edges.where(ACTIVE).where(F.col(here) == node.strip().lower()).select(F.col(there).alias("node"), "weight")


def degrees(edges: DataFrame) -> DataFrame:
    """Out- and in-degree of every node with an active edge."""
    e = edges.where(ACTIVE)
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, seeds: DataFrame | None = None, alpha: float = 0.85, iterations: int = 100, tol: float = 1e-6, check_every: int = 5) -> DataFrame:
    """(query_id, node, score), personalised for each query of seeds(query_id, node, weight); else for all nodes alike.

    Transitions go by weight; what dangling nodes hold, and 1 - alpha, goes back to the seeds. Seeds that name no node
    are left out; a query without any is spread evenly. Ends after `iterations` or when the sum of changes of every
    query is below tol, looked at every `check_every` rounds.
    """
    spark = edges.sparkSession
    e = edges.where(ACTIVE)
    every = (nodes.select(F.col("canon").alias("node")) if nodes is not None else e.select(F.col("src").alias("node")).union(e.select("dst"))).distinct()
    every = cut(every)
    n = every.count()
    if not n:
        return spark.createDataFrame([], "query_id string, node string, score double")
    out = e.groupBy("src").agg(F.sum("weight").alias("_sum"))
    step = cut(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_sum")).alias("p")))
    if seeds is None:
        start = every.select(F.lit("all").alias("query_id"), "node", F.lit(1.0 / n).alias("seed"))
    else:
        s = seeds.select("query_id", tx.canonical(F.col("node")).alias("node"), F.col("weight").cast("double").alias("w")).join(every, "node", "left_semi").where("w > 0").groupBy("query_id", "node").agg(F.sum("w").alias("w"))
        s = s.withColumn("seed", F.col("w") / F.sum("w").over(Window.partitionBy("query_id"))).select("query_id", "node", "seed")
        lost = cut(seeds.select("query_id").distinct().join(s.select("query_id").distinct(), "query_id", "left_anti"))
        if not lost.isEmpty():  # these have one rank in common, which is computed once
            even = pagerank(edges, nodes, None, alpha, iterations, tol, check_every).drop("query_id")
            known = seeds.join(lost, "query_id", "left_anti")
            mine = pagerank(edges, nodes, known, alpha, iterations, tol, check_every)
            return mine.unionByName(lost.crossJoin(even))  # the result has a row for each node of each such query
        start = s
    start = cut(start)
    rank = start.select("query_id", "node", F.col("seed").alias("score"))
    for i in range(1, iterations + 1):
        # Written in each round: it is read twice, for the ranks and for what they leave to the seeds.
        flow = cut(rank.join(step, rank.node == step.src).groupBy("query_id", F.col("dst").alias("node")).agg((alpha * F.sum(F.col("score") * F.col("p"))).alias("score")))
        back = flow.groupBy("query_id").agg(F.sum("score").alias("t"))
        home = start.join(back, "query_id", "left").select("query_id", "node", (F.col("seed") * (1 - F.coalesce("t", F.lit(0.0)))).alias("score"))
        nxt = flow.unionByName(home).groupBy("query_id", "node").agg(F.sum("score").alias("score"))
        if i % check_every == 0 and tol > 0:
            was = rank.select("query_id", "node", F.col("score").alias("was"))
            worst = nxt.join(was, ["query_id", "node"], "full_outer").groupBy("query_id").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))).alias("d")).agg(F.max("d")).first()[0]
            if (worst or 0.0) < tol:
                return nxt
        rank = nxt
    return rank


def paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 3, max_paths: int = 5) -> DataFrame:
    """pairs(query_id, a, b) to the first `max_paths` simple undirected paths, shortest first, then by their nodes.

    Each distinct pair is searched once, depth by depth, and no deeper when it has enough paths. The last two hops meet
    in the middle: for each distinct (last node, end) only the first few nodes between are kept, as many as can be
    needed when those already on the path are left out. So a hub costs its neighbours, not its paths.
    """
    e = edges.where(ACTIVE)
    u = cut(e.select(F.col("src").alias("x"), F.col("dst").alias("y")).union(e.select("dst", "src")).where("x != y").distinct())
    todo = cut(pairs.select("a", "b").where("a != b").distinct())
    prefix = todo.select("a", "b", F.array("a").alias("nodes"))  # simple paths from a, depth - 2 hops long, that miss b
    first = Window.partitionBy("a", "b").orderBy(F.concat_ws("\x00", "nodes"))
    found = None
    for depth in range(1, max_depth + 1):
        if depth == 1:
            hit = todo.join(u, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).select("a", "b", F.array("a", "b").alias("nodes"))
        else:
            if depth > 2:
                far = prefix.join(todo, ["a", "b"], "left_semi").join(u, F.element_at("nodes", -1) == F.col("x"))
                prefix = cut(far.where((F.col("y") != F.col("b")) & ~F.array_contains("nodes", F.col("y"))).select("a", "b", F.concat("nodes", F.array("y")).alias("nodes")))
            ends = prefix.join(todo, ["a", "b"], "left_semi").select(F.element_at("nodes", -1).alias("x"), "b").distinct()
            between = ends.join(u, "x").select(F.col("x").alias("at"), "b", F.col("y").alias("m")).join(u, (F.col("m") == F.col("x")) & (F.col("b") == F.col("y")))
            few = between.withColumn("_n", F.row_number().over(Window.partitionBy("at", "b").orderBy("m"))).where(F.col("_n") <= max_paths + depth - 2).select("at", F.col("b").alias("_b"), "m")
            j = prefix.join(todo, ["a", "b"], "left_semi").join(few, (F.element_at("nodes", -1) == F.col("at")) & (F.col("b") == F.col("_b")))
            hit = j.where(~F.array_contains("nodes", F.col("m"))).select("a", "b", F.concat("nodes", F.array("m", "b")).alias("nodes"))
        hit = cut(hit.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max_paths).drop("_n"))
        found = hit if found is None else found.unionByName(hit)
        if depth < max_depth:
            enough = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max_paths)
            todo = cut(todo.join(enough, ["a", "b"], "left_anti"))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.size("nodes"), F.concat_ws("\x00", "nodes")))).where(F.col("rank") <= max_paths)
    return pairs.select("query_id", "a", "b").distinct().join(best, ["a", "b"]).select("query_id", "a", "b", "nodes", "rank")


def path_edges(found: DataFrame) -> DataFrame:
    """How many paths use each undirected pair."""
    hop = F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.struct(F.least(F.element_at("nodes", i), F.element_at("nodes", i + 1)).alias("a"), F.greatest(F.element_at("nodes", i), F.element_at("nodes", i + 1)).alias("b")))
    return found.select(F.inline(hop)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def decay(edges: DataFrame, factor: float) -> DataFrame:
    """G07"""
    if not 0 < factor < 1:
        return edges
    return edges.withColumn("weight", F.col("weight") * factor)


def low_weight(edges: DataFrame, below: float) -> DataFrame:
    """Active edges below a weight."""
    return edges.where((F.col("weight") > 0) & (F.col("weight") < below))


def isolated(nodes: DataFrame, edges: DataFrame, frozen_count: bool = False) -> DataFrame:
    """Nodes without an active edge; frozen_count: nodes of frozen edges with hashes don't count as isolated."""
    e = edges if frozen_count else edges.where(ACTIVE)
    if frozen_count:
        e = edges.where((F.col("weight") > 0) | (F.size("relation_hashes") > 0))
    used = e.select(F.col("src").alias("canon")).union(e.select("dst")).distinct()
    return nodes.join(used, "canon", "left_anti").select("canon", "name")


def prune_hashes(edges: DataFrame, operations: DataFrame) -> DataFrame:
    """operations(src, dst, hash): hashes leave their edge; an edge without any goes to weight 0."""
    ops = operations.groupBy("src", "dst").agg(F.collect_set("hash").alias("gone"))
    j = edges.join(ops, ["src", "dst"], "left")
    left = F.when(F.col("gone").isNotNull(), F.array_except("relation_hashes", "gone")).otherwise(F.col("relation_hashes"))
    return j.select("src", "dst", F.when(F.col("gone").isNotNull() & (F.size(left) == 0), 0.0).otherwise(F.col("weight")).alias("weight"), left.alias("relation_hashes"))


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relation hashes at each node, in order of edge and hash."""
    e = edges.select("src", "dst", F.explode("relation_hashes").alias("hash"))
    at = e.withColumn("canon", F.col("src")).unionByName(e.where("src != dst").withColumn("canon", F.col("dst")))
    w = Window.partitionBy("canon").orderBy("src", "dst", "hash")
    return at.join(nodes.select("canon"), "canon", "left_semi").withColumn("n", F.row_number().over(w))


def rebuild_hash_map(edges: DataFrame, relations: DataFrame) -> DataFrame:
    """Hash sets of all edges from the relations."""
    r = relations.groupBy(tx.canonical(F.col("subject")).alias("src"), tx.canonical(F.col("object")).alias("dst")).agg(F.array_sort(F.collect_set("hash")).alias("_h"))
    return edges.join(r, ["src", "dst"], "left").withColumn("relation_hashes", F.coalesce("_h", F.array().cast("array<string>"))).drop("_h")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with its rank (from 1) in a full order. Rows are dealt to ranges and sorted there; only the ranges' sizes meet in one place."""
    cols = df.columns
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_m"))
    d = cut(d.select(*cols, F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")))
    size = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = size.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row a range
    return d.join(before, "_p").select(*cols, (F.col("_b") + F.col("_i") + 1).alias("rank"))


def saliency_filter(scores: DataFrame, edges: DataFrame, density: float = 0.5, hub_share: float = 0.1, ghost_share: float = 0.2) -> DataFrame:
    """scores(node, score) with band: kept (top share by density, or next to a hub), ghost (the band below), or dropped."""
    n = scores.count()
    r = ranked(scores.select("node", "score"), F.desc("score"), F.col("node"))
    hubs = r.where(F.col("rank") <= max(1, int(n * hub_share))).select("node")
    e = edges.where(ACTIVE)
    near = e.join(hubs.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).union(e.join(hubs.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src")).distinct().withColumn("_h", F.lit(True))
    j = r.join(near, "node", "left")
    kept = (F.col("rank") <= math.ceil(n * density)) | F.coalesce("_h", F.lit(False))
    return j.select("node", "score", F.when(kept, "kept").when(F.col("rank") <= math.ceil(n * (density + ghost_share)), "ghost").otherwise("dropped").alias("band"))


def source_subgraph(store: dict[str, DataFrame], source: str, exclude_leaf: bool = False) -> DataFrame:
    """Edges among a source's relations; without nodes of degree 1 unless nothing would be left."""
    p = store["paragraph"].where(F.col("source") == source).select(F.col("hash").alias("paragraph_hash"))
    hashes = store["paragraph_relation"].join(p, "paragraph_hash", "left_semi").select("relation_hash").distinct()
    e = store["edge"].select("src", "dst", "weight", F.explode("relation_hashes").alias("relation_hash")).join(hashes, "relation_hash", "left_semi")
    e = e.groupBy("src", "dst", "weight").agg(F.array_sort(F.collect_set("relation_hash")).alias("relation_hashes"))
    if not exclude_leaf:
        return e
    deg = degrees(e).where("out_degree + in_degree > 1").select("node")
    core = e.join(deg.withColumnRenamed("node", "src"), "src", "left_semi").join(deg.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*e.columns)
    some = core.agg(F.count(F.lit(1)).alias("_n"))
    return core.unionByName(e.crossJoin(F.broadcast(some)).where("_n = 0").drop("_n"))  # `some` is one row


def rank_nodes(scores: DataFrame, k: int | None = None, minimum: float = 0.0) -> DataFrame:
    """G17"""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    r = scores.where(F.col("score") >= minimum).withColumn("rank", F.row_number().over(w))
    return r if k is None else r.where(F.col("rank") <= k)


def compare_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per node both scores and their difference; one row of counts is left to the caller."""
    j = a.select("node", F.col("score").alias("a")).join(b.select("node", F.col("score").alias("b")), "node", "full_outer")
    return j.select("node", "a", "b", F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("common").alias("kind"), (F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))).alias("delta"))


def seed_weights(nodes: DataFrame, edges: DataFrame, method: str = "uniform") -> DataFrame:
    """Uniform, by degree, or by inverse degree, adding up to 1."""
    d = nodes.select(F.col("canon").alias("node")).join(degrees(edges), "node", "left").select("node", F.coalesce(F.col("out_degree") + F.col("in_degree"), F.lit(0)).alias("d"))
    w = {"uniform": F.lit(1.0), "degree": F.col("d").cast("double"), "inverse_degree": 1.0 / F.greatest(F.col("d"), F.lit(1))}[method]
    d = d.withColumn("w", w)
    total = d.agg(F.sum("w").alias("_t"), F.count(F.lit(1)).alias("_n"))  # one row
    return d.crossJoin(F.broadcast(total)).select("node", F.when(F.col("_t") > 0, F.col("w") / F.col("_t")).otherwise(1.0 / F.col("_n")).alias("weight"))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, active edges and density."""
    c = nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.where(ACTIVE).agg(F.count(F.lit(1)).alias("edges")))  # single rows
    return c.withColumn("density", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0))


def mentions(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node names that occur in a query's text, whatever the case, with the number of (overlapping) occurrences."""
    q = queries.select("query_id", F.lower("text").alias("t"))
    hits = matcher.occurrences(q, nodes, "query_id", "t", "canon")
    return hits.groupBy(F.col("id").alias("query_id"), F.col("pattern").alias("canon")).agg(F.count(F.lit(1)).alias("n"))


def query_seeds(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Seeds of a personalised rank: the nodes that a query names, as often as it does."""
    return mentions(queries, nodes).select("query_id", F.col("canon").alias("node"), F.col("n").cast("double").alias("weight"))


def seed_entities(queries: DataFrame, nodes: DataFrame, limit: int = 2) -> DataFrame:
    """The most often named nodes, longer ones first, then by name."""
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), F.desc(F.char_length("canon")), "canon")
    return mentions(queries, nodes).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def token_entities(queries: DataFrame, nodes: DataFrame, most: int = 4) -> DataFrame:
    """Word n-grams that are node names, longest first, no two overlapping. A query has few words, so the choice is a fold."""
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)[\s,，。!?！？;；:：()（）]+"), lambda x: x != "")
    q = queries.select("query_id", w.alias("w")).where(F.size("w") > 0)
    spans = q.select("query_id", "w", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size("w")))).alias("len"))
    at = spans.select("query_id", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    hit = at.select("query_id", "len", "i", F.lower(F.array_join(F.slice("w", F.col("i"), F.col("len")), " ")).alias("canon")).join(nodes.select("canon"), "canon")
    items = hit.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("len")).alias("l"), "i", "len", "canon"))).alias("xs"))
    empty = F.array().cast("array<struct<l:int,i:int,len:int,canon:string>>")
    kept = F.aggregate("xs", empty, lambda acc, x: F.when(F.exists(acc, lambda y: (x["i"] < y["i"] + y["len"]) & (y["i"] < x["i"] + x["len"])), acc).otherwise(F.concat(acc, F.array(x))))
    return items.select("query_id", F.posexplode(F.array_distinct(F.transform(kept, lambda x: x["canon"]))).alias("position", "canon"))


def recall(seeds: DataFrame, edges: DataFrame, k: int = 24, two_hop_below: int = 3, max_paths: int = 4) -> DataFrame:
    """seeds(query_id, canon, rank) to relation candidates (query_id, hash, candidate_type, graph_hops, rank).

    Two seeds: relations between them, and over one node in between if these are fewer than `two_hop_below`; one seed:
    relations at it. A relation counts by its nearest kind; hashes in order; k at most.
    """
    s = seeds.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "canon"))).alias("x"))
    pair = s.where(F.size("x") >= 2).select("query_id", F.col("x")[0]["canon"].alias("a"), F.col("x")[1]["canon"].alias("b"))
    one = s.where(F.size("x") == 1).select("query_id", F.col("x")[0]["canon"].alias("a"))
    # Both directions of the edges at a seed: no other edge is read twice, taken apart or shuffled.
    ends = cut(pair.select(F.explode(F.array("a", "b")).alias("p")).union(one.select("a")).distinct())
    at = lambda here, there: edges.join(ends.withColumnRenamed("p", here), here, "left_semi").select(F.col(here).alias("p"), F.col(there).alias("q"), F.explode("relation_hashes").alias("hash"))
    u = cut(at("src", "dst").union(at("dst", "src")).distinct())
    direct = pair.join(u, (F.col("a") == F.col("p")) & (F.col("b") == F.col("q"))).select("query_id", "hash", F.lit("direct_pair").alias("candidate_type"), F.lit(1).alias("graph_hops")).distinct()
    few = pair.join(direct.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < two_hop_below).select("query_id", "a", "b")
    left = few.join(u.select(F.col("p").alias("a"), F.col("q").alias("m"), F.col("hash").alias("h1")), "a").where("m != b and m != a")
    via = left.join(u.select(F.col("q").alias("m"), F.col("p").alias("b"), F.col("hash").alias("h2")), ["m", "b"])
    mids = via.select("query_id", "m").distinct().withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("m"))).where(F.col("r") <= max_paths).select("query_id", "m")
    two = via.join(mids, ["query_id", "m"], "left_semi").select("query_id", F.explode(F.array("h1", "h2")).alias("hash")).distinct().select("query_id", "hash", F.lit("two_hop_pair").alias("candidate_type"), F.lit(2).alias("graph_hops"))
    # Each distinct seed's first k relations, found once however many queries name it.
    near = one.select("a").distinct().join(u.select("p", "hash").distinct(), F.col("a") == F.col("p")).withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy("hash"))).where(F.col("_n") <= k)
    hop = one.join(near.select("a", "hash"), "a").select("query_id", "hash", F.lit("one_hop_seed").alias("candidate_type"), F.lit(1).alias("graph_hops"))
    every = direct.unionByName(two).unionByName(hop)
    kind = F.when(F.col("candidate_type") == "direct_pair", 0).otherwise(1)
    best = every.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "hash").orderBy(kind))).where("_n = 1").drop("_n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(kind, "hash"))).where(F.col("rank") <= k)


def entity_pivot(hits: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entity hits(query_id, hash, score, rank) to the relations at them; the best-ranked hit of a relation counts."""
    h = hits.join(entities.select("hash", tx.canonical(F.col("name")).alias("canon")), "hash").select("query_id", "canon", "score", "rank")
    ends = [relations.select(F.col("hash").alias("relation_hash"), tx.canonical(F.col(c)).alias("canon")) for c in ("subject", "object")]
    j = h.join(ends[0].union(ends[1]).distinct(), "canon")
    w = Window.partitionBy("query_id", "relation_hash").orderBy("rank", "canon")
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("query_id", F.col("relation_hash").alias("hash"), "score", "rank")


def has_node(nodes: DataFrame, name: str) -> DataFrame:
    """The node of a name, if there is one."""
    return nodes.where(F.col("canon") == name.strip().lower())


def edge_has(edges: DataFrame, src: str, dst: str, hash_: str) -> Column | DataFrame:
    """The edge, if its set has the hash."""
    return edges.where((F.col("src") == src) & (F.col("dst") == dst) & F.array_contains("relation_hashes", hash_))
