"""Column builders on hand-made rows and against plain Python."""

import hashlib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from memspark.functions import text as tx
from memspark.functions import time as tm
from memspark.functions import vector as vx
from memspark.plans.engine import parse_relation_query
from memspark.sources import readers
from pyspark.sql import functions as F


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(build(F.col("c")).alias("x")).first().x


TEXTS = [None, "", "  a \r\n b\t\tc  \n", "x　y z", "A|b|c", "a|b", "l\nl\nl\nl\nl", "然后他说道", "他是人", "### one", "“quoted” \"said\"", "Term\rnext"]


def test_normalize(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: (r.n, r.h) for r in df.select("i", tx.normalize(F.col("t")).alias("n"), tx.content_hash(tx.normalize(F.col("t"))).alias("h")).collect()}
    for i, t in enumerate(TEXTS):
        want = re.sub(r"[^\S\n]+", " ", (t or "").strip().replace("\r\n", "\n").replace("\r", "\n"))
        assert got[i] == (want, hashlib.sha256(want.encode()).hexdigest())


def test_classifiers(spark):
    kinds = dict(zip(TEXTS, ["mixed", "mixed", "mixed", "mixed", "structured", "mixed", "quote", "narrative", "factual", "narrative", "narrative", "mixed"]))
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r.t: r.k for r in df.select("t", tx.knowledge_type(F.col("t")).alias("k")).collect()}
    assert {t: got[t] for t in kinds} == kinds
    s = df.select("t", tx.import_strategy(F.col("t"), F.lit(" Quote ")).alias("o"), tx.import_strategy(F.col("t"), F.lit("auto"), F.lit(True)).alias("c")).collect()
    assert {r.o for r in s} == {"quote"} and {r.c for r in s} == {"narrative"}


def test_stored_type(spark):
    rows = [("factual", "x", "factual"), (" Imported ", "x", "factual"), ("junk", "a|b|c", "structured"), ("auto", "a|b|c", "structured"), ("", "plain", "mixed"), ("junk", "", "mixed")]
    df = spark.createDataFrame(rows, "v string, c string, w string")
    for r in df.select("w", tx.stored_type(F.col("v"), F.col("c"), True, "mixed").alias("x")).collect():
        assert r.x == r.w
    assert one(spark, "junk", lambda c: tx.stored_type(c, F.lit("x"))) is None


def test_ngrams_and_lists(spark):
    assert one(spark, "A b\nC", tx.char_ngrams) == ["ab", "bc"]
    assert one(spark, "a", tx.char_ngrams) == ["a"] and one(spark, "", tx.char_ngrams) == [] and one(spark, None, tx.char_ngrams) == []
    assert one(spark, "b a B c", lambda c: tx.tokens(c)) == ["b", "a", "c"]
    assert one(spark, [" Ann ", "bob", "ANN", ""], tx.keep_order, "array<string>") == ["Ann", "bob"]
    assert one(spark, '["a", "b"]', tx.json_list) == ["a", "b"] and one(spark, "no", tx.json_list) == []
    assert one(spark, "a=1 b=\"x y\" c='z'", tx.key_values) == {"a": "1", "b": "x y", "c": "z"}
    assert one(spark, "7.5", lambda c: tx.clamp(c, 0, 5, 1)) == 5 and one(spark, "x", lambda c: tx.clamp(c, 0, 5, 1)) == 1
    assert one(spark, "YES", tx.as_bool) is True and one(spark, "?", tx.as_bool) is False
    assert tuple(one(spark, "relation-ab-c", tx.parse_hash_key)) == ("relation", "ab-c")


def test_times(spark):
    day = 1_704_067_200
    assert one(spark, "2024/01/01", tm.parse_query_time) == day
    assert one(spark, "2024/01/01", lambda c: tm.parse_query_time(c, True)) == day + 86340
    assert one(spark, "2024/01/01 10:30", tm.parse_query_time) == day + 37800
    assert one(spark, "2024-01-01", tm.parse_query_time) is None
    for text, want in [("2024-01-01T10:30", day + 37800), ("2024/01/01 10:30:05", day + 37805), ("12.5", 12.5), ("-3", -3.0), ("soon", None), ("", None)]:
        assert one(spark, text, tm.parse_ingest_time) == want
    r = spark.createDataFrame([("2024/01/02", "2024/01/01")], "a string, b string").select(tm.parse_query_range(F.col("a"), F.col("b")).alias("r")).first().r
    assert r.ok is False
    assert one(spark, day + 37800, tm.format_time, "long") == "2024/01/01 10:30"


@settings(deadline=None, max_examples=15)
@given(st.lists(st.floats(-100, 100, width=32), min_size=1, max_size=24))
def test_quantize_round_trip(spark, v):
    r = spark.createDataFrame([(v,)], "v array<float>").select(vx.quantize_int8(F.col("v")).alias("q")).select("q", vx.dequantize_int8(F.col("q")).alias("d")).first()
    step = (max(v) - min(v)) / 255
    assert all(-128 <= c <= 127 for c in r.q.codes) and all(abs(a - b) <= step / 2 + 1e-6 for a, b in zip(v, r.d))


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], vx.normalize, "array<float>") == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], vx.normalize, "array<float>") == [0.0, 0.0]
    assert [one(spark, v, vx.is_valid, "array<float>") for v in ([1.0], [], [math.nan], [math.inf], None)] == [True, False, False, False, False]
    want = int(hashlib.sha1(b"k").hexdigest()[:16], 16) & (2**63 - 1)
    assert one(spark, "k", vx.vector_id) == want
    assert vx.bytes_saved(10, 8)["saved_ratio"] == 0.75
    q = spark.createDataFrame([([0.0] * 4 + [1.0] * 4,)], "v array<float>").select(vx.product_quantize(F.col("v"), 2, 256).alias("q")).select("q.codes", vx.product_dequantize(F.col("q"), 4).alias("d")).first()
    assert q.codes == [0, 255] and q.d == [0.0] * 4 + [1.0] * 4


@pytest.mark.parametrize("text,want", [("a|b|c", ("a", "b", "c")), ("a -> b -> c", ("a", "b", "c")), ("a b c d", ("a", "b", "c d")), ("a b", ("", "", "")), ("", ("", "", ""))])
def test_parse_relation(spark, text, want):
    assert tuple(one(spark, text, readers.parse_relation)) == want


def test_relation_query(spark):
    cases = {"a|b": (True, "a", "b", None, None), "|b|c": (True, None, "b", "c", None), "a->b": (True, "a", None, "b", None), "->": (True, None, None, None, "invalid_arrow_format"), "Ann likes tea": (True, "Ann", "likes", "tea", None), "Who likes tea": (False, None, None, None, None), "two words": (False, None, None, None, None), "": (False, None, None, None, "empty")}
    for text, want in cases.items():
        assert tuple(one(spark, text, parse_relation_query)) == want
