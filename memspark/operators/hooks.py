"""Model hooks: extraction, time hints and embeddings as Arrow batches with fixed schemas, and checks around them."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as vx

EXTRACTED = "struct<triples:array<struct<subject:string,predicate:string,object:string>>,entities:array<string>,events:array<string>>"


def retried(call: Callable, attempts: int = 3, wait_s: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """The call, tried again after doubling waits; the last error is raised."""

    def run(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except Exception:
                if k == attempts - 1:
                    raise
                sleep(wait_s * 2**k)

    return run


def extract(chunks: DataFrame, model: Callable[[list[str]], list[str]], text_col: str = "text") -> DataFrame:
    """Adds `extracted` from the model's JSON answers, one call for each Arrow batch; an answer that is no JSON is null."""

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        return pd.Series(model(texts.fillna("").tolist()), dtype=object)

    answer = F.regexp_extract(ask(F.col(text_col)), r"(?s)(\{.*\})", 1)
    return chunks.withColumn("extracted", F.from_json(F.nullif(answer, F.lit("")), EXTRACTED))


def time_hints(chats: DataFrame, model: Callable[[list[str], list[float]], list[str]]) -> DataFrame:
    """chats(text, reference_time): adds the event time that the model reads from the text, as JSON fields of a paragraph item."""

    @F.pandas_udf("string")
    def ask(texts: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series(model(texts.fillna("").tolist(), at.tolist()), dtype=object)

    return chats.withColumn("time_meta", F.from_json(ask(F.col("text"), F.col("reference_time")), "event_time string, event_time_start string, event_time_end string, time_granularity string, time_confidence string"))


def embedder(model: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A model as a Column function, one call for each Arrow batch; a failed text is null."""

    @F.pandas_udf("array<float>")
    def ask(texts: pd.Series) -> pd.Series:
        return pd.Series(model(texts.fillna("").tolist()), dtype=object)

    return ask


def self_check(vectors: DataFrame, dim: int) -> DataFrame:
    """One row: vectors, those of another dimension, those with invalid numbers, and whether all is well."""
    v = F.col("embedding")
    out = vectors.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.coalesce(F.size(v) != dim, F.lit(True))).alias("wrong_dim"), F.count_if(~vx.is_valid(v)).alias("invalid"))
    return out.withColumn("ok", (F.col("wrong_dim") == 0) & (F.col("invalid") == 0))


def drift(stored: DataFrame, again: DataFrame, least: float = 0.99) -> DataFrame:
    """(hash, similarity, ok) of vectors that a model makes anew of texts that it embedded before."""
    j = stored.select("hash", F.col("embedding").alias("a")).join(again.select("hash", F.col("embedding").alias("b")), "hash")
    s = F.when(F.size("a") == F.size("b"), vx.dot(vx.normalize(F.col("a")), vx.normalize(F.col("b")))).otherwise(0.0)
    return j.select("hash", s.alias("similarity"), (s >= least).alias("ok"))
