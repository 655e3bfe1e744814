"""Many patterns in many texts: windows of power-of-two length, a filter of the patterns' rarest windows, exact checks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshot import cut

#: Bits of the filter: about sixteen for each key, within these bounds (2^27 bits are 16 MB).
LEAST_BITS, MOST_BITS = 12, 27
#: Code points of texts that are hashed together, and found places that go out together.
PIECE, OUT = 1 << 20, 20_000
#: Places in a pattern that may be its key.
WINDOWS = 32
#: Stands between texts; no text has it.
WALL = 0x110000
SEEN = "level int, h bigint, front string, back string, at int"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def window_hashes(codes: np.ndarray, most: int):
    """(level, hashes of all windows of 2^level code points): each level from the one before."""
    with np.errstate(over="ignore"):
        h, size = _mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
        for level in range(most + 1):
            yield level, h
            if len(h) <= size:
                return
            h = _mix(h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:] + np.uint64(level + 1))
            size *= 2


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a wall after each, and where each text begins."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    start = np.append(0, np.cumsum([len(p) + 1 for p in parts]))
    out = np.full(start[-1], WALL, np.uint32)
    for p, a in zip(parts, start, strict=False):
        out[a : a + len(p)] = p
    return out, start


def keys(patterns: DataFrame) -> DataFrame:
    """(pattern, len, level, off, h): of WINDOWS windows of the largest power of two that fits in a pattern, the one that fewest patterns have."""

    def run(batches):
        for b in batches:
            rows = [[], [], [], []]
            for name, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                level = int(math.log2(len(p)))
                h = dict(window_hashes(np.frombuffer(p.encode("utf-32-le", "surrogatepass"), "<u4"), level))[level].view(np.int64)
                off = np.unique(np.linspace(0, len(h) - 1, WINDOWS).astype(int))
                for c, v in zip(rows, ([name] * len(off), [level] * len(off), off.tolist(), h[off].tolist()), strict=True):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64())], names=["id", "level", "off", "h"])

    named = patterns.select(F.unhex(F.sha2("pattern", 256)).alias("id"), "pattern")
    own = cut(named.mapInArrow(run, "id binary, level int, off int, h bigint"))
    often = own.groupBy("level", "h").agg(F.count(F.lit(1)).alias("n"))
    best = own.join(often, ["level", "h"]).groupBy("id").agg(F.min(F.struct("n", "off", "level", "h")).alias("k"))
    return cut(named.join(best, "id").select("pattern", F.char_length("pattern").alias("len"), "k.level", "k.off", "k.h"))


def _filter(found: DataFrame) -> tuple[bytes, int, dict[int, tuple[int, int]]]:
    """(bits, their logarithm, {level: characters that a check needs before and from the key}): made where the keys lie, a word for 64 bits."""
    n = found.count()
    size = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * n + 1))))
    mask, words = (1 << size) - 1, np.zeros(1 << (size - 6), np.uint64)
    at = found.select(F.explode(F.array(F.col("h").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("h", 64 - size))).alias("i"))
    got = at.groupBy(F.shiftright("i", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(i & 63 as int)))").alias("bits")).collect()  # 2^(size - 6) rows at most
    for r in got:
        words[r.w] = np.uint64(r.bits & (2**64 - 1))
    need = found.groupBy("level").agg(F.max("off").alias("front"), F.max(F.col("len") - F.col("off")).alias("back")).collect()  # a row a level
    return words.tobytes(), size, {r.level: (r.front, r.back) for r in need}


def occurrences(texts: DataFrame, patterns: DataFrame, id_col: str = "id", text_col: str = "text", pattern_col: str = "pattern", once: bool = False) -> DataFrame:
    """(id, pattern, at): every place, counted in code points from 0, where a text holds a pattern, overlapping ones too.

    Case counts; nulls and empty strings hold and match nothing; a pattern counts once, rows of texts count each. A text's
    windows are looked up in a filter of fixed size that all tasks have; only places that pass it are shuffled, with the
    few characters around them that the exact check needs. So what is shuffled grows with what is found, not with texts
    times lengths, and a pattern that is in many texts is found in the task of each. once: of places of a text that look
    alike one is enough; a pattern may still come more than once.
    """
    kind = texts.schema[id_col].dataType.simpleString()
    names = patterns.select(F.col(pattern_col).alias("pattern")).where("pattern != ''").distinct()
    found = keys(names)
    bits, size, levels = _filter(found)
    sent = texts.sparkSession.sparkContext.broadcast(bits)
    slim = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text != ''")

    def run(batches):
        held = np.frombuffer(sent.value, np.uint8)
        mask = np.uint64((1 << size) - 1)
        has = lambda i: (held[i >> np.uint64(3)] >> (i & np.uint64(7)).astype(np.uint8)) & 1

        def look(ids, some):
            codes, start = _codes(some)
            for level, h in window_hashes(codes, max(levels)):
                if level not in levels:
                    continue
                before, after = levels[level]
                ok = np.flatnonzero(has(h & mask))
                ok = ok[has(h[ok] >> np.uint64(64 - size)) == 1]
                text = np.searchsorted(start, ok, side="right") - 1
                at, width = ok - start[text], 1 << level
                inside = at + width <= np.diff(start)[text] - 1
                ok, text, at = ok[inside], text[inside], at[inside]
                for k in range(0, len(ok), OUT):
                    t, a = text[k : k + OUT].tolist(), at[k : k + OUT].tolist()
                    rows = [(i, v, some[i][max(0, j - before) : j], some[i][j : j + after], j) for i, v, j in zip(t, h[ok[k : k + OUT]].view(np.int64).tolist(), a, strict=True)]
                    if once:
                        rows = list({x[:4]: x for x in rows}.values())
                    t, *place = map(list, zip(*rows, strict=True))
                    place = [pa.array([level] * len(t), pa.int32()), *(pa.array(c, kind) for c, kind in zip(place, (pa.int64(), pa.string(), pa.string(), pa.int32()), strict=True))]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(t, pa.int64())), *place], names=["id", "level", "h", "front", "back", "at"])

        for b in batches:
            ids, some, begin, n = b.column(0), b.column(1).to_pylist(), 0, 0
            for k, t in enumerate(some):
                n += len(t) + 1
                if n >= PIECE or k + 1 == len(some):
                    yield from look(ids.slice(begin, k + 1 - begin), some[begin : k + 1])
                    begin, n = k + 1, 0

    if not levels:
        return texts.sparkSession.createDataFrame([], f"id {kind}, pattern string, at int")
    seen = slim.mapInArrow(run, f"id {kind}, {SEEN}")
    near = F.char_length("front")
    same = (near >= F.col("off")) & (F.substring(F.concat("front", "back"), near - F.col("off") + 1, F.col("len")) == F.col("pattern"))
    return seen.join(found, ["level", "h"]).where(same).select("id", "pattern", (F.col("at") - F.col("off")).alias("at"))


def held(texts: DataFrame, patterns: DataFrame, id_col: str = "id", text_col: str = "text", pattern_col: str = "pattern") -> DataFrame:
    """(id, pattern): the patterns that each text holds, once."""
    return occurrences(texts, patterns, id_col, text_col, pattern_col, once=True).select("id", "pattern").distinct()
