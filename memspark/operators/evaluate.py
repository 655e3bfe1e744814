"""Retrieval evaluation: query sets from triples, IR metrics, objectives, parameter search."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.snapshot import cut

#: Profiles that one plan scores: they are sent to all tasks.
MOST_PROFILES = 4096
# Weights of the metrics by objective, and the categories' least hit rates.
OBJECTIVES = {
    "precision_priority": ((0.40, 0.20, 0.15, 0.15, 0.10), 0.15, 0.25, {"query_nl": 0.70, "query_kw": 0.55, "spo_search": 0.58, "spo_relation": 0.92}),
    "balanced": ((0.25, 0.20, 0.15, 0.25, 0.15), 0.10, 0.18, {"query_nl": 0.65, "query_kw": 0.52, "spo_search": 0.55, "spo_relation": 0.90}),
    "recall_priority": ((0.15, 0.15, 0.15, 0.40, 0.15), 0.05, 0.12, {"query_nl": 0.60, "query_kw": 0.48, "spo_search": 0.52, "spo_relation": 0.88}),
}
CATEGORY_WEIGHTS = {"query_nl": 1.0, "query_kw": 1.1, "spo_search": 1.0, "spo_relation": 1.2}


def sample_triples(relations: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """N triples, predicates in turn, those with rare entities first."""
    ends = relations.select(F.lower("subject").alias("e")).union(relations.select(F.lower("object"))).groupBy("e").agg(F.count(F.lit(1)).alias("c"))
    ends = cut(ends)
    total = ends.agg(F.sum("c")).first()[0] or 0
    bar = max(1000, total // 1000)

    def counted(rows: DataFrame, end: str, name: str) -> DataFrame:
        """rows with the count of an end. Names with many relations, a thousand at most, are sent to all tasks: none gets all of theirs."""
        rows, told = rows.withColumn("_e", F.lower(end)), ends.select(F.col("e").alias("_e"), F.col("c").alias(name))
        often = F.broadcast(told.where(F.col(name) >= bar))
        rest = rows.join(often, "_e", "left_anti").join(told.where(F.col(name) < bar), "_e")
        return rows.join(often, "_e").unionByName(rest).drop("_e")

    j = counted(counted(relations.select("hash", "subject", "predicate", "object"), "subject", "cs"), "object", "co")
    w = Window.partitionBy("predicate").orderBy(F.col("cs") + F.col("co"), F.xxhash64(F.lit(seed), "hash"), "hash")
    # A turn beyond n has n rows of its own predicate before it.
    return j.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", "predicate").limit(n).select("hash", "subject", "predicate", "object", "turn")


def query_set(triples: DataFrame) -> DataFrame:
    """Four cases of each triple: natural language, keywords, and the triple as a search and as a relation query."""
    t = triples.withColumn("seq", F.row_number().over(Window.orderBy("turn", "predicate", "hash")) - 1)  # a sample
    s, p, o = F.col("subject"), F.col("predicate"), F.col("object")
    v = F.col("seq") % 4
    nl = F.when(v == 0, F.concat_ws(" ", F.lit("What is the relation between"), s, F.lit("and"), o)).when(v == 1, F.concat_ws(" ", s, p, F.lit("what?"))).when(v == 2, F.concat_ws(" ", F.lit("Who or what"), p, o)).otherwise(F.concat_ws(" ", F.lit("Tell me about"), s, p, o))
    kw = F.when(v == 0, F.concat_ws(" ", s, o)).when(v == 1, F.concat_ws(" ", s, p)).when(v == 2, F.concat_ws(" ", p, o)).otherwise(F.concat_ws(" ", o, s, p))
    cases = [("query_nl", nl), ("query_kw", kw), ("spo_search", F.concat_ws(" ", s, p, o)), ("spo_relation", F.concat_ws("|", s, p, o))]
    rows = F.array(*[F.struct(F.lit(c).alias("category"), q.alias("text")) for c, q in cases])
    e = t.select("seq", F.array("hash").alias("expected_hashes"), F.inline(rows))
    return e.select(F.concat_ws("-", "category", F.col("seq").cast("string")).alias("query_id"), "category", "text", "expected_hashes")


def metrics(cases: DataFrame, results: DataFrame, k: int = 20) -> DataFrame:
    """One row; results(query_id, hash, rank); a case hits at the least rank of an expected hash."""
    per = per_case(cases, results, k)
    hit = lambda n: F.avg((F.coalesce(F.col("rank") <= n, F.lit(False))).cast("double"))
    rel = F.col("category") == "spo_relation"
    return per.agg(
        F.count(F.lit(1)).alias("total"), hit(1).alias("precision_at_1"), hit(3).alias("precision_at_3"),
        F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), hit(k).alias("recall_at_k"),
        F.coalesce(F.avg(F.when(rel, F.col("rank").isNotNull().cast("double"))), F.lit(0.0)).alias("spo_relation_hit_rate"),
        F.avg((F.col("n") == 0).cast("double")).alias("empty_rate"),
    )


def per_case(cases: DataFrame, results: DataFrame, k: int = 20) -> DataFrame:
    """Per case the rank of the first expected hash within k, or null, and the number of results."""
    r = results.where(F.col("rank") <= k)
    first = cases.select("query_id", F.explode("expected_hashes").alias("hash")).join(r, ["query_id", "hash"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    n = r.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return cases.select("query_id", "category").join(first, "query_id", "left").join(n, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def by_category(cases: DataFrame, results: DataFrame, k: int = 20) -> DataFrame:
    """A16"""
    return per_case(cases, results, k).groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count("rank").alias("hit"))


def objective(m: dict[str, float], categories: dict[str, tuple[int, int]], name: str = "precision_priority") -> float:
    """Weighted metrics less the share of empty results and shortfalls below the categories' least hit rates; categories: (total, hit)."""
    weights, empty, scale, floors = OBJECTIVES.get(name, OBJECTIVES["precision_priority"])
    keys = ("precision_at_1", "precision_at_3", "mrr", "recall_at_k", "spo_relation_hit_rate")
    raw = sum(w * m.get(key, 0.0) for w, key in zip(weights, keys, strict=True))
    short = [(CATEGORY_WEIGHTS[c], max(0.0, f - categories[c][1] / categories[c][0])) for c, f in floors.items() if categories.get(c, (0, 0))[0] > 0]
    total = sum(w for w, _ in short)
    return raw - empty * m.get("empty_rate", 1.0) - (scale * sum(w * x for w, x in short) / total if total else 0.0)


def search_parameters(grid: dict[str, list], run: Callable[[dict], float], rounds: int, seed: int = 42) -> tuple[dict, float, list[tuple[dict, float]]]:
    """Random search: each round changes one or two parameters of the best profile so far. Returns profile, score, history."""
    rng = random.Random(seed)
    best = {k: v[0] for k, v in grid.items()}
    score = run(best)
    history = [(dict(best), score)]
    for _ in range(rounds):
        trial = best | {k: rng.choice(grid[k]) for k in rng.sample(sorted(grid), min(len(grid), rng.choice((1, 2))))}
        s = run(trial)
        history.append((trial, s))
        if s > score:
            best, score = trial, s
    return best, score, history


def over_profiles(lists: dict[str, DataFrame], profiles: DataFrame, k: int = 20) -> DataFrame:
    """(profile_id, query_id, hash, score, rank): lists(query_id, hash, score) fused by reciprocal rank for all profiles in one plan.

    profiles(profile_id, rrf_k, and w_<list> for each list): at most MOST_PROFILES, sent to all tasks. Each list is ranked
    once; a profile is a column of the plan, not a run of its own. What weighs nothing in a profile isn't found by it.
    """
    if profiles.limit(MOST_PROFILES + 1).count() > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles")
    # Dealt by query once, with as many rows as the lists have: profiles come after.
    every = reduce(DataFrame.unionByName, [df.select("query_id", "hash", "score", F.lit(name).alias("list")) for name, df in lists.items()]).repartition("query_id")
    ranked = every.withColumn("r", F.row_number().over(Window.partitionBy("list", "query_id").orderBy(F.desc("score"), "hash")))
    found = ranked.groupBy("query_id", "hash").agg(F.array_sort(F.collect_list(F.struct("list", "r"))).alias("at"))
    weights = profiles.select("profile_id", "rrf_k", *[F.col(f"w_{n}").cast("double").alias(f"w_{n}") for n in lists])
    weight = lambda x: F.coalesce(*[F.when(x["list"] == n, F.col(f"w_{n}")) for n in lists], F.lit(0.0))
    fused = found.crossJoin(F.broadcast(weights)).withColumn("at", F.filter("at", lambda x: weight(x) > 0)).where(F.size("at") > 0)
    fused = fused.select("profile_id", "query_id", "hash", F.aggregate("at", F.lit(0.0), lambda s, x: s + weight(x) / (F.col("rrf_k") + x["r"])).alias("score"))
    best = Window.partitionBy("profile_id", "query_id").orderBy(F.desc(F.round("score", 12)), "hash")
    return fused.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def score_profiles(cases: DataFrame, results: DataFrame, profiles: DataFrame, objective: str = "precision_priority", k: int = 20) -> DataFrame:
    """Metrics and objective of each profile; results(profile_id, query_id, hash, rank) as of over_profiles()."""
    weights, empty, scale, floors = OBJECTIVES.get(objective, OBJECTIVES["precision_priority"])
    total = cases.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("category") == c).alias(f"of_{c}") for c in CATEGORY_WEIGHTS])
    mine = results.join(cases.select("query_id"), "query_id", "left_semi").where(F.col("rank") <= k)
    asked = cases.select("query_id", "category", F.explode("expected_hashes").alias("hash"))
    first = mine.join(asked, ["query_id", "hash"]).groupBy("profile_id", "query_id", "category").agg(F.min("rank").alias("rank"))
    hits = first.groupBy("profile_id").agg(
        F.count_if(F.col("rank") <= 1).alias("h1"), F.count_if(F.col("rank") <= 3).alias("h3"), F.sum(1.0 / F.col("rank")).alias("rr"), F.count(F.lit(1)).alias("hk"),
        *[F.count_if(F.col("category") == c).alias(f"hit_{c}") for c in CATEGORY_WEIGHTS],
    )
    some = mine.groupBy("profile_id").agg(F.count_distinct("query_id").alias("answered"))
    j = profiles.select("profile_id").join(hits, "profile_id", "left").join(some, "profile_id", "left").na.fill(0).crossJoin(F.broadcast(total))  # one row
    share = lambda c, of="total": F.when(F.col(of) > 0, F.col(c) / F.col(of)).otherwise(0.0)
    j = j.select("*", share("h1").alias("precision_at_1"), share("h3").alias("precision_at_3"), share("rr").alias("mrr"), share("hk").alias("recall_at_k"), share("hit_spo_relation", "of_spo_relation").alias("spo_relation_hit_rate"), (1 - share("answered")).alias("empty_rate"))
    keys = ("precision_at_1", "precision_at_3", "mrr", "recall_at_k", "spo_relation_hit_rate")
    raw = reduce(add, [w * F.col(c) for w, c in zip(weights, keys, strict=True)])
    there = {c: F.when(F.col(f"of_{c}") > 0, CATEGORY_WEIGHTS[c]).otherwise(0.0) for c in floors}
    short = reduce(add, [there[c] * F.greatest(F.lit(0.0), f - share(f"hit_{c}", f"of_{c}")) for c, f in floors.items()])
    whole = reduce(add, list(there.values()))
    lost = F.when(whole > 0, scale * short / whole).otherwise(0.0)
    return j.select("profile_id", *keys, "empty_rate", (raw - empty * F.col("empty_rate") - lost).alias("objective"))


def halving(cases: DataFrame, lists: dict[str, DataFrame], profiles: DataFrame, objective: str = "precision_priority", k: int = 20, first: float = 0.25) -> tuple[DataFrame, list[int]]:
    """R45 by successive halving: (the best profile with its metrics over all cases, how many profiles each round had).

    Each round scores all profiles that are left in one job, over a share of the cases that doubles from `first`; the
    better half goes on (ties: the smaller id), and the last round is over all cases.
    """
    left, share, sizes = profiles, first, []
    n = profiles.count()
    while True:
        some = cases if share >= 1 or n <= 2 else cases.where(F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
        w = Window.orderBy(F.desc(F.round("objective", 12)), "profile_id")  # MOST_PROFILES rows at most
        told = cut(score_profiles(some, over_profiles(lists, left, k), left, objective, k).withColumn("place", F.row_number().over(w)))
        sizes.append(n)
        if some is cases and n <= 2 or n <= 1:
            return told.where("place = 1").drop("place"), sizes
        n, share = max(1, (n + 1) // 2), min(1.0, 2 * share)
        left = cut(left.join(told.where(F.col("place") <= n).select("profile_id"), "profile_id", "left_semi"))
        if n <= 2:
            share = 1.0


def failures(cases: DataFrame, results: DataFrame, k: int = 20, most: int = 5) -> DataFrame:
    """Cases that were missed."""
    return per_case(cases, results, k).where("rank is null").orderBy("query_id").limit(most)


def hit_rate(c: Column) -> Column:
    return F.avg(c.cast("double"))
