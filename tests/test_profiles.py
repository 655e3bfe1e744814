"""All profiles in one plan, and successive halving, against a plain grid."""

import random

import pytest
from memspark.operators import evaluate


def brute(cases, lists, profile, k, objective):
    """Metrics and objective of one profile by hand."""
    ranks, empty = {}, 0
    for q, category, expected in cases:
        score = {}
        for name, rows in lists.items():
            own = sorted(((-s, h) for x, h, s in rows if x == q))
            for r, (_, h) in enumerate(own, 1):
                if profile[f"w_{name}"] > 0:
                    score[h] = score.get(h, 0) + profile[f"w_{name}"] / (profile["rrf_k"] + r)
        best = [h for _, h in sorted((-round(s, 12), h) for h, s in score.items())[:k]]
        empty += not best
        ranks[q] = (category, min((best.index(h) + 1 for h in expected if h in best), default=None))
    n = len(cases)
    hit = lambda top: sum(r is not None and r <= top for _, r in ranks.values()) / n
    rel = [r is not None for c, r in ranks.values() if c == "spo_relation"]
    m = {"precision_at_1": hit(1), "precision_at_3": hit(3), "mrr": sum(1 / r for _, r in ranks.values() if r) / n, "recall_at_k": hit(k), "spo_relation_hit_rate": sum(rel) / len(rel) if rel else 0.0, "empty_rate": empty / n}
    by = {c: (sum(x == c for x, _ in ranks.values()), sum(x == c and r is not None for x, r in ranks.values())) for c in evaluate.CATEGORY_WEIGHTS}
    return m | {"objective": evaluate.objective(m, by, objective)}


@pytest.mark.parametrize("objective", ["precision_priority", "recall_priority"])
def test_grid_and_halving(spark, objective):
    r = random.Random(5)
    cases = [(f"q{i}", r.choice(list(evaluate.CATEGORY_WEIGHTS)), [f"h{r.randrange(30)}"]) for i in range(24)]
    lists = {"dense": [], "words": []}
    for q, _, expected in cases[:22]:
        for name, good in (("dense", 0.8), ("words", 0.3)):
            some = {f"h{r.randrange(30)}": r.random() for _ in range(12)} | ({expected[0]: 2.0} if r.random() < good else {})
            lists[name] += [(q, h, s) for h, s in some.items()]
    profiles = [(i, float(k), a, 1 - a) for i, (k, a) in enumerate((k, a) for k in (10, 60) for a in (0.0, 0.25, 0.5, 0.75, 1.0))]
    frames = {n: spark.createDataFrame(x, "query_id string, hash string, score double") for n, x in lists.items()}
    p = spark.createDataFrame(profiles, "profile_id int, rrf_k double, w_dense double, w_words double")
    c = spark.createDataFrame(cases, "query_id string, category string, expected_hashes array<string>")
    told = {x.profile_id: x.asDict() for x in evaluate.score_profiles(c, evaluate.over_profiles(frames, p, 5), p, objective, 5).collect()}
    want = {i: brute(cases, lists, {"rrf_k": k, "w_dense": a, "w_words": b}, 5, objective) for i, k, a, b in profiles}
    for i, m in want.items():
        assert all(told[i][key] == pytest.approx(v) for key, v in m.items())
    best, sizes = evaluate.halving(c, frames, p, objective, 5, first=1.0)
    assert best.first().profile_id == min(want, key=lambda i: (-round(want[i]["objective"], 12), i)) and sizes == [10, 5, 3, 2]
    quick, _ = evaluate.halving(c, frames, p, objective, 5)
    assert want[quick.first().profile_id]["objective"] >= sorted(x["objective"] for x in want.values())[-4]


def test_profiles_are_not_shuffled(spark):
    """lists are dealt by query once, however many profiles fuse them."""
    store, jvm, gateway = spark.sparkContext._jsc.sc().statusStore(), spark._jvm, spark.sparkContext._gateway

    def shuffled():
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    rows = spark.range(4000).selectExpr("id % 40 query_id", "concat('h', id) hash", "double(id) score")
    profiles = spark.range(20).selectExpr("id profile_id", "60 rrf_k", "id / 19.0D w_a", "1 - id / 19.0D w_b")
    before = shuffled()
    got = evaluate.over_profiles({"a": rows, "b": rows}, profiles).collect()
    assert len(got) == 20 * 40 * 20 and all(x.hash == f"h{4000 - 40 * x['rank'] + x.query_id}" for x in got)
    assert shuffled() - before < 3 * 8000
