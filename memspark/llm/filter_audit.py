"""Filter interaction audit: what each filter removes under every order, from cells of failure masks."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_ID, Work

#: The conditions under which a document fails a filter of its own text, by letter; the last letter stands for copies.
LETTERS, COPIES = "ABCDE", "E"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def conditions(text: Column) -> dict[str, Column]:
    """A: under 50 words; B: under 65 % distinct words; C: over 5 % A-Z; D: a character of #$%&*|."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n, length = F.size(words), F.char_length(text)
    upper = length - F.char_length(F.translate(text, UPPER, ""))
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n.cast("long"),
        "C": 100 * upper.cast("long") > 5 * length.cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame | None = None, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, mask, n, good, toxic: documents by part and by the set of filters they fail (bit k: letter k).

    Texts are read once; what is shuffled of a document is its id, part, mask and the SHA-256 of its text.
    """
    work = Work(docs.sparkSession, "audit")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bit = {c: 1 << k for k, c in enumerate(LETTERS)}
    own = sum((F.when(fails, bit[c]).otherwise(0) for c, fails in conditions(text).items()), F.lit(0))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")) if part_col.lower() in [c.lower() for c in docs.columns] else F.lit("")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), part.alias("part"), own.alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = work.save(rows.groupBy("doc_id", "part", "own", "digest").agg(F.count(F.lit(1)).alias("n")), "rows")
    # Only the row with a text's smallest id doesn't fail the filter of copies; the join has the id in its key, so that no group of copies is one key.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["doc_id", "digest"], "left")
    if labels is not None:
        one = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
        rows = rows.join(labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic")), "doc_id", "left")
    else:
        rows = rows.withColumn("quality", F.lit(0)).withColumn("toxic", F.lit(0))
    mask = (F.col("own") + F.when(F.col("first"), 0).otherwise(bit[COPIES])).cast("int")
    marked = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    found = rows.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), marked("quality").alias("good"), marked("toxic").alias("toxic"))
    return work.save(found, "cells")


def steps(spark, letters: str = LETTERS) -> DataFrame:
    """mask, filter_order, step, letter, fails, failed: for each mask and order, whether the step's filter and any earlier one fails."""
    orders = ["".join(p) for p in permutations(letters)]
    long = spark.range(1 << len(letters)).select(F.col("id").cast("int").alias("mask"), F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    long = long.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter")).where("letter <> ''")
    long = long.withColumn("hit", F.col("mask").bitwiseAND(F.expr(f"shiftleft(1, instr('{letters}', letter) - 1)")))
    before = W.partitionBy("mask", "filter_order").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    failed = F.coalesce(F.bit_or("hit").over(before), F.lit(0)) != 0
    return long.select("mask", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "letter", (F.col("hit") != 0).alias("fails"), failed.alias("failed"))


def audit(docs: DataFrame, labels: DataFrame | None = None, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The five filters are those of `conditions`, and E: the text is identical (by SHA-256) to that of a smaller id, in any
    part, removed or not. Parts are the values of part_col; null, or a table without the column, is the empty string. All
    120 orders are told, zeros included. A null text is empty; a null id is smaller than all others; rows repeated with one
    id are each counted, and none is a copy of the others. A document is good or toxic if any of its label rows says 1; a
    null id has no label. An empty table gives no rows; further columns, whatever their names, are ignored.

    Documents become cells of (part, mask) first, at most 32 a part; these meet the 19 200 steps of masks and orders (a
    fixed number, broadcast), where a running bit-or tells earlier failures, and are summed for each step.
    """
    one = cells(docs, labels, part_col, id_col, text_col).join(F.broadcast(steps(docs.sparkSession)), "mask")
    fails, failed = F.col("fails"), F.col("failed")
    when = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    alone = fails & (F.bit_count("mask") == 1)
    told = one.groupBy("part", "filter_order", "step", "letter").agg(
        when(~fails & ~failed, "n").alias("kept"), when(fails & ~failed, "n").alias("removed"), when(fails & failed, "n").alias("redundant"),
        when(alone, "n").alias("unique_fails"), when(fails & ~failed, "good").alias("good_lost"), when(fails & ~failed, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(W.partitionBy("part", "letter"))
    return told.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))
