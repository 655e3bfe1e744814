"""The corpus pipeline: toxicity, line dedup, near dedup, mixing, packing. Part of the subpackage memspark.llm."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import near_dedup
from memspark.llm.common import delete, scratch, shared_dir, tune
from memspark.llm.line_dedup import line_dedup
from memspark.llm.mixing import sample
from memspark.llm.packing import pack_documents
from memspark.llm.toxicity import fit, score


def with_own_columns(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], *made: str) -> DataFrame:
    """stage(docs) with the columns of docs, also those that are named as what the stage makes."""
    aside = {c: f"_own_{uuid.uuid4().hex[:8]}" for c in docs.columns if c.lower() in made}
    return stage(docs.withColumnsRenamed(aside)).drop(*made).withColumnsRenamed({v: k for k, v in aside.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_own_columns(docs, lambda d: score(d, model).where("predicted = 0"), "score", "predicted")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur across documents stay in the first; n_chars follows the text."""
    return with_own_columns(docs, line_dedup, "n_lines", "n_dropped").withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest id; rows that share an id, or have none, are told apart."""
    return near_dedup.drop_near_copies(docs, words=5, percent=80)


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have their target weights."""
    return sample(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of fixed size, each without two documents of a source."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("mixing", sample_mixture),
    ("packing", pack_windows),
]

#: SQL can't express the first stage; the tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage is written as Parquet and read again.

    Rows are documents: rows that share an id, or have none, are judged each by its own text, so that exactly one row of
    every group of equal or near texts goes on. Texts are whole at any length. Ties in an id are broken as near_dedup says,
    ties in size by a hash in packing. Nulls in any column, empty and blank texts and repeated rows go through the stages as
    their operators say; blank texts are no copies of one another. Further columns, whatever their names, are carried to
    mixing as they are. Without labels no document is toxic, and an empty table gives no rows. A stage's work tables are
    deleted once its result is written, and its result once the next one is; the last goes when the application ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline_{uuid.uuid4().hex[:12]}"
    tune(spark)
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark, f"{root}/work{k}"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{root}/{k}")
        if k:
            delete(spark, f"{root}/{k - 1}")
        docs = spark.read.parquet(f"{root}/{k}")
    delete(spark, root, at_exit=True)
    return docs
