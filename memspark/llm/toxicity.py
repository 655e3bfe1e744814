"""Toxicity: a linear classifier over character n-grams that naive Bayes log-count ratios scale."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Work, clean_columns, pieces, put

BITS = 20
SIZES = (4, 5, 6)
#: Tasks that the bounded sample's features are counted in.
FIT_TASKS = 16
_MUL = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)


@dataclass
class Model:
    """slot: feature number of each hash bucket or -1; weight: of the features present in a text."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float


def grams(texts: list[str]):
    """Per n-gram size: (size, hash bucket of each position, end of text k as a position); windows may cross texts."""
    low = [t.lower() for t in texts]
    off = np.append(0, np.cumsum([len(t) for t in low], dtype=np.int64))
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = c.copy()
    for n in range(2, max(SIZES) + 1):
        if len(c) < n:
            return
        h = h[:-1] * _MUL + c[n - 1 :]
        if n in SIZES:
            yield n, ((h + np.uint32(n)) * _SPREAD) >> np.uint32(32 - BITS), off


def present(texts: list[str], slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs; features are buckets, or those that `slot` names."""
    docs, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n, bucket, off in grams(texts):
        if slot is None:
            at, f = np.arange(len(bucket)), bucket.astype(np.int64)
        else:
            f = slot[bucket]
            at = np.flatnonzero(f >= 0)
            f = f[at].astype(np.int64)
        doc = np.searchsorted(off, at, side="right") - 1
        inside = at + n <= off[doc + 1]
        docs.append(doc[inside])
        features.append(f[inside])
    pair = np.unique(np.concatenate(docs) << 32 | np.concatenate(features))
    return pair >> 32, pair & (2**32 - 1)


def _texts(b: pa.RecordBatch, col: str) -> list[str]:
    return b.column(b.schema.get_field_index(col)).fill_null("").to_pylist()


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32(doc_id as text) mod 5 = 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def logistic(doc: np.ndarray, feature: np.ndarray, scale: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Ridge logistic regression over scaled presence, by full-batch Adam; examples weigh as much in either class."""
    k, n = len(scale), len(y)
    w, bias, m, v = np.zeros(k), 0.0, np.zeros(k + 1), np.zeros(k + 1)
    x = scale[feature]
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for t in range(1, rounds + 1):
        z = np.bincount(doc, weights=x * w[feature], minlength=n) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        grad = np.append(np.bincount(feature, weights=x * g[doc], minlength=k) + ridge * w / max(1, k), g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w * scale, float(bias)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, min_docs: int = 4, min_z: float = 4.0, min_features: int = 1000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from at most `per_class` labelled rows of each class, chosen by a hash of the id, none of them held out.

    Features count if in `min_docs` of these and their log-count ratio is `min_z` standard errors from 0; if these are
    fewer than `min_features`, that many that are furthest from 0.
    Ids with contradictory labels are left out. Without examples of both classes the model is a constant.
    """
    work = Work(docs.sparkSession, "toxicity")
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    marked = marked.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_most")).where("_y = _most").select("_id", F.col("_y").cast("int").alias("_y"))
    marked = work.save(marked, "marked")
    total = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = [marked.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    sample = work.save(part[0].union(part[1]), "sample")  # 2 * per_class rows at most, so it may be broadcast
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    train = work.save(slim.join(F.broadcast(sample), "_id").select("_y", "_t"), "train")
    dealt = train.repartition(FIT_TASKS)

    def count(batches):
        found = np.zeros((2, 1 << BITS), np.int32)
        rows = np.zeros(2, np.int64)
        for b in batches:
            for p in pieces([b], "_t", 1 << 20):
                y = p.column(0).to_numpy()
                doc, f = present(_texts(p, "_t"))
                for k in (0, 1):
                    found[k] += np.bincount(f[y[doc] == k], minlength=1 << BITS).astype(np.int32)
                    rows[k] += (y == k).sum()
        if rows.sum():
            f = np.flatnonzero(found.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()]), pa.array([f.astype(np.uint32).tobytes()]), pa.array([found[:, f].tobytes()])], names=["rows", "f", "found"])

    found, rows = np.zeros((2, 1 << BITS)), np.zeros(2)
    # Written by all tasks at once, then read one part after the other: the driver never holds all counts.
    for r in work.save(dealt.mapInArrow(count, "rows binary, f binary, found binary"), "counts").toLocalIterator():
        f = np.frombuffer(r["f"], np.uint32)
        found[:, f] += np.frombuffer(r["found"], np.int32).reshape(2, -1)
        rows += np.frombuffer(r["rows"], np.int64)
    slot = np.full(1 << BITS, -1, np.int32)
    if not rows.all():
        work.drop("marked", "sample", "train", "counts", "features")
        return Model(slot, np.zeros(0), np.inf if rows[1] else -np.inf)
    ratio = np.log((found[1] + 1) / (rows[1] + 2)) - np.log((found[0] + 1) / (rows[0] + 2))
    error = np.sqrt(1 / (found[0] + 1) + 1 / (found[1] + 1))
    z = np.where(found.sum(axis=0) >= min_docs, np.abs(ratio) / error, 0.0)
    use = np.flatnonzero(z >= min_z)
    if len(use) < min_features:
        use = np.sort(np.argsort(-z, kind="stable")[: min(min_features, int((z > 0).sum()))])
    slot[use] = np.arange(len(use))
    sent = docs.sparkSession.sparkContext.broadcast(slot)

    def featurise(batches):
        for b in batches:
            for p in pieces([b], "_t", 1 << 20):
                doc, f = present(_texts(p, "_t"), sent.value)
                yield pa.RecordBatch.from_arrays([pa.array([p.column(0).to_numpy().astype(np.int8).tobytes()]), pa.array([doc.astype(np.uint32).tobytes()]), pa.array([f.astype(np.uint32).tobytes()])], names=["y", "doc", "f"])

    ys, docs_, fs, at = [], [], [], 0
    for r in work.save(dealt.mapInArrow(featurise, "y binary, doc binary, f binary"), "features").toLocalIterator():
        ys.append(np.frombuffer(r["y"], np.int8))
        docs_.append(np.frombuffer(r["doc"], np.uint32).astype(np.int64) + at)
        fs.append(np.frombuffer(r["f"], np.uint32).astype(np.int64))
        at += len(ys[-1])
    sent.destroy()
    weight, bias = logistic(np.concatenate(docs_), np.concatenate(fs), ratio[use], np.concatenate(ys).astype(float))
    work.drop("marked", "sample", "train", "counts", "features")
    prior = np.log(total[1] / total[0])  # the regression saw either class as often
    return Model(slot, weight, bias + float(prior))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's rows and columns, and score (0 to 1) and predicted (1 if score >= 0.5).

    Whole texts are scored, however long; null and empty ones get the score of no n-gram. Equal texts have equal scores,
    rows repeated in the input are scored each, input columns named like a result column are replaced, and an empty
    table gives no rows.
    """
    docs = clean_columns(docs, "score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for p in pieces(batches, text_col, 1 << 20):
            doc, f = present(_texts(p, text_col), m.slot)
            z = np.bincount(doc, weights=m.weight[f], minlength=p.num_rows) + m.bias
            with np.errstate(over="ignore"):
                s = 1 / (1 + np.exp(-z))
            yield put(p, score=pa.array(s), predicted=pa.array((s >= 0.5).astype(np.int32)))

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """The input's rows and columns, and held_out, score, predicted.

    Each whole text is scored by the presence of hashed character n-grams (4 to 6, lower-cased), weighted by a linear
    classifier over features that naive Bayes log-count ratios scale (see fit). Labels, language, source and id are no
    inputs of a score, so equal texts have equal scores. Null and empty texts get the score of no n-gram. Rows repeated
    in the input are scored each; input columns named like a result column are replaced; empty tables give no rows;
    without labels of both classes every score is 0, or 1 if all labels are 1.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **options)
    return score(clean_columns(docs, "held_out").withColumn("held_out", held_out(F.col(id_col))), model, text_col)
