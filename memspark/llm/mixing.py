"""Mixing sources to target weights: raking to source, language and topic marginals, then sampling by calibrated probability."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Work, mix64, pieces, put, texts_of
from .shingles import words

MARGINS = ("source", "lang", "topic")
#: Topics, hash classes of words whose document frequencies are counted, dimensions of a text's vector, and rounds of k-means.
TOPICS, CLASSES, DIMS, ROUNDS = 8, 1 << 14, 64, 6
#: Rows from which the first centres are chosen; all rows take part in the rounds.
CANDIDATES = 64
#: Cells of the contingency table that are raked on the driver; more are raked as a table, to the same tolerance.
CELLS = 100_000
TOLERANCE = 1e-9
#: Probabilities are rounded to this many digits, far above the tolerance: both ways of raking keep the same rows.
DIGITS = 6
NONE = "\x00"


@dataclass
class Topics:
    """weight: inverse document frequency of each class of words; centres: one unit vector a topic (none: all texts are topic 0)."""

    weight: np.ndarray
    centres: np.ndarray


def _classes(batch: pa.RecordBatch, col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, text number, word hash) with each distinct word of a text once."""
    w, begin = words(*texts_of(batch, col))
    n = np.diff(begin)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((w, doc))
    w, doc = w[order], doc[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
    return n, doc[new], w[new]


def vectors(n: int, doc: np.ndarray, w: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of n texts: signed sums of their distinct words' weights in DIMS dimensions, scaled to length 127, as whole numbers from -127 to 127."""
    spread = mix64(w ^ np.uint64(0x9E3779B97F4A7C15))
    x = weight[(w % np.uint64(CLASSES)).astype(np.int64)] * np.where(spread >> np.uint64(63), 1.0, -1.0)
    v = np.bincount(doc * DIMS + (spread % np.uint64(DIMS)).astype(np.int64), weights=x, minlength=n * DIMS).reshape(n, DIMS)
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.rint(v / np.where(length > 0, length, 1.0) * 127).astype(np.int8)


def nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre that a vector points to most; the first of several, and 0 for a text without words."""
    return np.argmax(v.astype(np.float64) @ centres.T, axis=1) if len(centres) else np.zeros(len(v), np.int64)


def first_centres(v: np.ndarray, k: int) -> np.ndarray:
    """k of the given vectors, each the one that is least like those before it."""
    unit = v.astype(np.float64)
    unit = unit[np.abs(unit).sum(axis=1) > 0]
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    if not len(unit):
        return np.zeros((0, DIMS))
    chosen, like = [0], unit @ unit[0]
    while len(chosen) < min(k, len(unit)) and like.min() < 1 - 1e-9:
        chosen.append(int(np.argmin(like)))
        like = np.maximum(like, unit @ unit[chosen[-1]])
    return unit[chosen]


def fit_topics(slim: DataFrame, work: Work, k: int = TOPICS) -> Topics:
    """Spherical k-means over vectors of all texts; slim: doc_id, text. Sums are of whole numbers, so that every run finds the same centres."""

    def count(batches):
        total, rows = np.zeros(CLASSES, np.int64), 0
        for p in pieces(batches, "text", 1 << 20):
            _, _, w = _classes(p, "text")
            total += np.bincount((w % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES)
            rows += p.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int64()), pa.array([rows, *total[used].tolist()], pa.int64())], names=["class", "n"])

    weight, n = np.zeros(CLASSES), 0
    for r in slim.select("text").mapInArrow(count, "class bigint, n bigint").groupBy("class").agg(F.sum("n").alias("n")).collect():  # CLASSES rows and one
        if r["class"] < 0:
            n = r["n"]
        else:
            weight[r["class"]] = r["n"]
    weight = np.log((n + 1) / (weight + 1))
    weight[weight < 0] = 0.0  # classes of several words that most texts have
    sent = slim.sparkSession.sparkContext.broadcast(weight)

    def embed(batches):
        for p in pieces(batches, "text", 1 << 20):
            _, doc, w = _classes(p, "text")
            v = vectors(p.num_rows, doc, w, sent.value)
            yield pa.RecordBatch.from_arrays([p.column(p.schema.get_field_index("doc_id")), pa.array([x.tobytes() for x in v], pa.binary())], names=["doc_id", "v"])

    table = work.save(slim.mapInArrow(embed, "doc_id bigint, v binary"), "vectors", packed=True)
    first = table.select("v", F.xxhash64(F.lit(3), "doc_id").alias("h")).orderBy("h", "v").limit(CANDIDATES).collect()
    centres = first_centres(np.stack([np.frombuffer(r["v"], np.int8) for r in first]) if first else np.zeros((0, DIMS)), k)
    for _ in range(ROUNDS if len(centres) > 1 else 0):

        def add(batches: Iterator[pa.RecordBatch], centres=centres):
            total = np.zeros((len(centres), DIMS), np.int64)
            for b in batches:
                v = np.frombuffer(b"".join(b.column(0).to_pylist()), np.int8).reshape(-1, DIMS)
                np.add.at(total, nearest(v, centres), v)
            c, d = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), pa.array(total[c, d])], names=["c", "d", "n"])

        total = np.zeros((len(centres), DIMS))
        for r in table.select("v").mapInArrow(add, "c bigint, d bigint, n bigint").groupBy("c", "d").agg(F.sum("n").alias("n")).collect():  # k * DIMS rows at most
            total[r["c"], r["d"]] = r["n"]
        length = np.sqrt((total * total).sum(axis=1, keepdims=True))
        moved = np.where(length > 0, total / np.where(length > 0, length, 1.0), centres)  # a topic that lost all texts stays where it was
        if (moved == centres).all():
            break
        centres = moved
    work.drop("vectors")
    return Topics(weight, centres)


def measured(docs: DataFrame, topics: Topics, text_col: str = "text", keep_text: bool = True, n_tokens: str = "n_tokens", topic: str = "topic") -> DataFrame:
    """The rows with two columns more, of the given names, and without the text unless keep_text."""
    sent = docs.sparkSession.sparkContext.broadcast(topics)
    fields = [f for f in docs.schema if keep_text or f.name != text_col]

    def run(batches):
        for p in pieces(batches, text_col, 1 << 20):
            n, doc, w = _classes(p, text_col)
            found = nearest(vectors(p.num_rows, doc, w, sent.value.weight), sent.value.centres)
            yield put(p.select([f.name for f in fields]), **{n_tokens: pa.array(n.astype(np.int64)), topic: pa.array(found.astype(str).tolist(), pa.string())})

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField(n_tokens, T.LongType()), T.StructField(topic, T.StringType())]))


def tempered(weights: np.ndarray, alpha: float) -> np.ndarray:
    """Shares in proportion to weights ** alpha; nothing for nothing."""
    w = np.where(weights > 0, np.power(np.maximum(weights, 1e-300), alpha), 0.0)
    return w / w.sum() if w.sum() else w


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, tolerance: float = TOLERANCE) -> np.ndarray:
    """Factor of each cell by iterative proportional fitting: tokens * factor has the target shares in each margin."""
    factor = np.ones(len(tokens))
    goal = [t * tokens.sum() / max(t.sum(), 1e-300) for t in targets]
    for _ in range(rounds):
        was = factor.copy()
        for code, want in zip(codes, goal, strict=True):
            have = np.bincount(code, weights=tokens * factor, minlength=len(want))
            factor *= np.where(have > 0, want / np.maximum(have, 1e-300), 1.0)[code]
        if np.abs(factor[was > 0] / was[was > 0] - 1).max(initial=0.0) < tolerance:
            break
    return factor


def scale_for(tokens: np.ndarray, factor: np.ndarray, budget: float) -> float:
    """s such that sum(tokens * min(1, s * factor)) is the budget."""
    order = np.argsort(-factor)
    t, f = tokens[order], factor[order]
    full = np.append(0, np.cumsum(t)[:-1])
    rest = np.cumsum((t * f)[::-1])[::-1]
    s = (budget - full) / np.maximum(rest, 1e-300)
    fits = np.flatnonzero((s * f <= 1) & (s >= 0))
    return float(s[fits[0]]) if len(fits) else float("inf")


def _rake_table(cells: DataFrame, goals: dict[str, DataFrame], work: Work, rounds: int, budget: float) -> DataFrame:
    """The same as rake() and scale_for() over a table of any size, one written table for each round."""
    now = work.save(cells.withColumn("factor", F.lit(1.0)), "cells_0")
    for r in range(1, rounds + 1):
        nxt = now.withColumn("was", F.col("factor"))
        for m in MARGINS:
            have = nxt.groupBy(m).agg(F.sum(F.col("tokens") * F.col("factor")).alias("have"))
            ratio = have.join(goals[m], m).select(m, F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(1.0).alias("ratio"))
            nxt = nxt.join(ratio, m).withColumn("factor", F.col("factor") * F.col("ratio")).drop("ratio")
        nxt = work.save(nxt, f"cells_{r}")
        off = nxt.where("was > 0").agg(F.max(F.abs(F.col("factor") / F.col("was") - 1))).first()[0]
        work.drop(f"cells_{r - 1}")
        now = nxt.drop("was")
        if (off or 0) < TOLERANCE:
            break
    s, full = 0.0, None
    for _ in range(100):
        capped = F.col("factor") * s >= 1
        a = now.agg(F.coalesce(F.sum(F.when(capped, F.col("tokens"))), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~capped, F.col("tokens") * F.col("factor"))), F.lit(0.0)).alias("rest")).first()
        if full is not None and a["full"] == full:
            break
        full = a["full"]
        s = (budget - full) / a["rest"] if a["rest"] else float("inf")
    return now.withColumn("probability", F.least(F.lit(1.0), F.col("factor") * s))


@dataclass
class Mixture:
    """rows: doc_id, the margins and n_tokens of each row; chosen: weight and probability of each cell; small: chosen may be broadcast; topics: if none was given."""

    rows: DataFrame
    chosen: DataFrame
    small: bool
    seed: int
    topics: Topics | None

    def attach(self, rows: DataFrame) -> DataFrame:
        """Rows with doc_id and the margins, and weight, probability and kept."""
        # 52 bits of a hash of the id: a uniform number that every run and every retried task agrees on.
        uniform = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), "doc_id"), 12) / float(1 << 52)
        joined = rows.join(F.broadcast(self.chosen) if self.small else self.chosen, list(MARGINS))
        return joined.withColumn("kept", uniform < F.col("probability"))


def plan_mixture(docs: DataFrame, fraction: float = 0.8, alpha: tuple[float, float, float] = (0.5, 0.7, 0.7), targets: dict[str, dict[str, float]] | None = None, topic_col: str | None = None, seed: int = 7, cells_on_driver: int = CELLS, id_col: str = "doc_id", text_col: str = "text") -> Mixture:
    """The cells' probabilities; see mix()."""
    spark = docs.sparkSession
    work = Work(spark, "mixing")
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    kinds = {f.name for f in docs.schema}
    margins: list[Column] = [as_text(c).alias(c) if c in kinds else F.lit(NONE).alias(c) for c in ("source", "lang")]
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *margins, *([as_text(topic_col).alias("given")] if topic_col else []))
    if topic_col:
        n = F.size(F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), "[\\x20\\x09-\\x0D]+"), ""))
        topics = None
        rows = work.save(slim.select("doc_id", "source", "lang", n.cast("long").alias("n_tokens"), F.col("given").alias("topic")), "rows")
    else:
        topics = fit_topics(slim.select("doc_id", "text"), work)
        rows = work.save(measured(slim, topics, keep_text=False), "rows")
    cells = work.save(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("tokens")), "cells")
    total = cells.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    small = total[1] <= cells_on_driver
    if small:  # a proven bound for what is collected and sent to all
        got = sorted(cells.collect())
        tokens, codes, want = np.array([r["tokens"] for r in got]), [], []
        for m, a in zip(MARGINS, alpha, strict=True):
            names = sorted({r[m] for r in got})
            at = {x: i for i, x in enumerate(names)}
            code = np.array([at[r[m]] for r in got], np.int64)
            have = np.bincount(code, weights=tokens, minlength=len(names)) if len(names) else np.zeros(0)
            given = (targets or {}).get(m)
            share = np.array([given.get(x, 0.0) for x in names]) if given else tempered(have, a)
            codes.append(code)
            want.append(np.where(have > 0, share, 0.0))
        factor = rake(tokens, codes, want) if len(got) else tokens
        s = scale_for(tokens, factor, fraction * tokens.sum()) if len(got) else 1.0
        chance = np.minimum(1.0, np.where(factor > 0, s * factor, 0.0)) if np.isfinite(s) else (factor > 0).astype(float)
        chosen = spark.createDataFrame([(*[r[m] for m in MARGINS], float(f), float(p)) for r, f, p in zip(got, factor, chance, strict=True)], ", ".join(f"{m} string" for m in MARGINS) + ", weight double, probability double")
    else:
        goals = {}
        for m, a in zip(MARGINS, alpha, strict=True):
            have = cells.groupBy(m).agg(F.sum("tokens").alias("have"))
            given = (targets or {}).get(m)
            share = have.join(spark.createDataFrame(list(given.items()), f"{m} string, share double"), m, "left").withColumn("share", F.coalesce("share", F.lit(0.0))) if given else have.withColumn("share", F.pow("have", F.lit(a)))
            share = work.save(share.withColumn("share", F.when(F.col("have") > 0, F.col("share")).otherwise(0.0)), f"goal_{m}")
            whole = share.agg(F.sum("share")).first()[0] or 1.0
            goals[m] = share.select(m, (F.col("share") * (total[0] / whole)).alias("want"))
        chosen = _rake_table(cells, goals, work, 200, fraction * (total[0] or 0.0)).select(*MARGINS, F.col("factor").alias("weight"), "probability")
    return Mixture(rows, chosen.withColumn("probability", F.round("probability", DIGITS)), small, seed, topics)


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, n_tokens, weight, probability, kept.

    Tokens are words [^\\x20\\x09-\\x0D]+. Cells of source x language x topic are raked until their tokens have the target
    shares in each margin; targets are given by name, or are the found shares to the power alpha, which lowers hot
    sources. A name that given targets miss has target 0: none of its documents is kept. A document's probability is
    min(1, s * weight) of its cell, with s such that `fraction` of all tokens are expected, to six digits; it is kept if
    a uniform hash of its id is below. Null source or language is a value of its own.

    Without topic_col a text's topic is its cluster: each distinct word counts by its inverse document frequency, the
    words' signed hashes make a vector, and spherical k-means over the vectors of all texts finds TOPICS centres.

    Rows repeated with one id share their fate unless they differ in source, language or text; null and empty texts, and
    those without words, are topic 0 and weigh nothing in the margins but are sampled like their cell. Texts count whole,
    however long. Ties between topics go to the first. Equal rows count each. An empty table gives no rows; further
    columns, whatever their names, are ignored.
    """
    m = plan_mixture(docs, **options)
    plain = [F.nullif(F.col(c), F.lit(NONE)).alias(c) for c in MARGINS]
    return m.attach(m.rows).select("doc_id", *plain, "n_tokens", "weight", "probability", "kept")


def sample(docs: DataFrame, id_col: str = "doc_id", topic_col: str | None = None, **options) -> DataFrame:
    """The rows and columns of docs that mix() keeps. Each row's cell is measured once more where it lies: no text is shuffled while the cells can be broadcast."""
    m = plan_mixture(docs, id_col=id_col, topic_col=topic_col, **options)
    rows = docs if m.topics is None else measured(docs, m.topics, options.get("text_col", "text"), n_tokens="_mix_tokens", topic="_mix_topic")
    keys = {"source": "source", "lang": "lang", "topic": topic_col or "_mix_topic"}
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)) if c in rows.columns else F.lit(NONE)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return m.attach(rows.select(whole, F.col(id_col).cast("long").alias("doc_id"), *[key(c).alias(m_) for m_, c in keys.items()])).where("kept").select("_row.*")
