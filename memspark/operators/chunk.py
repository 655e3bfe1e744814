"""Chunkers as table functions: text in, ordered chunks out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from . import matcher

# Marks of lists, terms, scenes and sentence ends.
_LIST = re.compile(r"[-*]\s+|\d+\.\s+")
_TERM = re.compile(r"[^：:]+[：:].+")
_SCENE = re.compile(r"^(?:#{1,6}[ \t\r\f\v]+.*|Chapter\s+\d+|\*{3,}$|={3,}$)", re.M)
_SENTENCE = re.compile(r"[。！？.!?]")
CHUNK = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])


def _structural(line: str) -> bool:
    s = line.strip()
    return bool(s) and bool(_LIST.match(s) or _TERM.match(s) or s[0] == s[-1] == "|")


def factual(text: str, target: int = 600) -> Iterator[tuple[int, int, str, str]]:
    """Lines up to the target size; not within lists, definitions and tables, unless twice as long."""
    begin = size = at = 0
    for line in text.split("\n"):
        at += len(line) + 1
        size += len(line) + 1
        if size >= target and (not _structural(line) or size >= 2 * target):
            yield begin, at - 1, "", text[begin : at - 1]
            begin, size = at, 0
    if size:
        yield begin, len(text), "", text[begin:]


def narrative(text: str, window: int = 800, overlap: int = 200) -> Iterator[tuple[int, int, str, str]]:
    """Scenes between headings, each in overlapping windows that end at a newline beyond their half if there is one."""
    marks = [(m.start(), m.end(), m[0].strip()) for m in _SCENE.finditer(text)]
    scenes, title, at = [], "Start", 0
    for a, z, name in [*marks, (len(text), len(text), "")]:
        if a > at and (at or text[at:a].strip()):
            scenes.append((at, a, title))
        title, at = name, z
    for a, z, title in scenes or [(0, len(text), "Whole Text")]:
        begin = a
        while True:
            end = min(begin + window, z)
            if end < z:
                cut = text.rfind("\n", begin, end) - begin
                end = begin + cut + 1 if cut > window // 2 else end
            yield begin, end, title, text[begin:end]
            if end >= z:
                break
            begin = end - overlap


def quote(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Stanzas between blank lines, verbatim."""
    at = 0
    for stanza in text.split("\n\n"):
        if stanza.strip():
            yield at, at + len(stanza), "", stanza
        at += len(stanza) + 2


def sentences(text: str, most: int = 500) -> Iterator[tuple[int, int, str, str]]:
    """Paragraphs; longer ones as runs of sentences below the size, each ended by an ideographic stop."""
    for para in (p.strip() for p in text.split("\n\n")):
        if not para:
            continue
        if len(para) <= most:
            yield 0, 0, "", para
            continue
        held = ""
        for s in (s.strip() for s in _SENTENCE.split(para)):
            if not s:
                continue
            if held and len(held) + len(s) >= most:
                yield 0, 0, "", held
                held = ""
            held += s + "。"
        if held:
            yield 0, 0, "", held


STRATEGIES: dict[str, Callable[[str], Iterator[tuple[int, int, str, str]]]] = {"factual": factual, "narrative": narrative, "quote": quote, "sentences": sentences}


def split(docs: DataFrame, strategy: str | None = None, text_col: str = "content") -> DataFrame:
    """The rows with idx, start, end, title and text of each chunk; strategy None: a column `strategy` names it.

    Arrow batches go to Python once for each batch; rows are never moved.
    """

    @F.pandas_udf(T.ArrayType(CHUNK))
    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([[(i, *c) for i, c in enumerate(STRATEGIES.get(n, narrative)(t or ""))] if t else [] for t, n in zip(texts, names, strict=True)])

    name = F.lit(strategy) if strategy else F.col("strategy")
    return docs.select("*", F.inline(run(F.col(text_col), name)))


def rescue(chunks: DataFrame) -> DataFrame:
    """Chunks of another strategy that look like quotes become quotes."""
    return chunks.withColumn("strategy", F.when(tx.is_quote(F.col("text")), "quote").otherwise(F.col("strategy")))


def match_patterns(texts: DataFrame, patterns: DataFrame | list[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, pattern, at) of every occurrence of any pattern; patterns(pattern) are a table of any size, or a list."""
    if isinstance(patterns, list):
        patterns = texts.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    return matcher.occurrences(texts, patterns, id_col, text_col)
