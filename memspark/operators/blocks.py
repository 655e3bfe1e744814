"""BM25 of many queries over forward rows in blocks: each task keeps its k best per query, so pairs are never shuffled."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshot import cut
from . import matrix

FORWARD = "hash string, dl int, terms array<string>, tfs array<int>"
#: Documents and entries of a block, queries of a block, and of these as many as are scored at once.
DOCS, ENTRIES, QUERIES, CHUNK = 2048, 1 << 19, 2048, 256
#: A term is a row of a matrix product from this share of a chunk's pairs, else its pairs are listed.
DENSE = 0.01


def forward(tokenised: DataFrame) -> DataFrame:
    """(hash, dl, terms, tfs): rows (hash, _t) of tokens, one for each document, counted where they lie. _t: an array, or a text of tokens without spaces, with spaces between."""
    joined = tokenised.schema["_t"].dataType.simpleString() == "string"

    def run(batches):
        for b in batches:
            terms, tfs, dl, off = [], [], [], [0]
            for t in b.column(1).to_pylist():
                t = [w for w in t.split(" ") if w] if joined and t else t or ()
                n = Counter(t)
                terms.extend(n)
                tfs.extend(n.values())
                off.append(len(terms))
                dl.append(len(t))
            lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.string()), (tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dl, pa.int32()), *lists], names=["hash", "dl", "terms", "tfs"])

    kind = tokenised.schema["hash"].dataType.simpleString()
    return tokenised.select("hash", "_t").mapInArrow(run, FORWARD.replace("hash string", f"hash {kind}"))


def grams(docs: DataFrame, n: int) -> DataFrame:
    """(hash, dl, terms, tfs): of rows (hash, t) the distinct n-grams of t, where it lies; a text shorter than n is its own."""

    def run(batches):
        for b in batches:
            found = [list(dict.fromkeys(t[i : i + n] for i in range(max(1, len(t) - n + 1)))) if t else [] for t in b.column(1).to_pylist()]
            sizes = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.string())), pa.array([[1] * x for x in sizes], pa.list_(pa.int32()))], names=["hash", "dl", "terms", "tfs"])

    kind = docs.schema["hash"].dataType.simpleString()
    return docs.select("hash", "t").mapInArrow(run, FORWARD.replace("hash string", f"hash {kind}"))


def gathered(postings: DataFrame) -> DataFrame:
    """Forward rows of postings(term, hash, tf, dl)."""
    p = postings.groupBy("hash").agg(F.first("dl").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("p"))
    return p.select("hash", "dl", F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs"))


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _coded(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(vocabulary, codes, offsets) of a column of lists."""
    flat, off = lists.flatten(), np.append(0, np.cumsum(_sizes(lists)))
    d = flat.dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False).astype(np.int32), off


def _packed(df: DataFrame, names: tuple[str, ...], rows: int, entries: int) -> DataFrame:
    """df(id, terms, values, ...) as rows of whole blocks, where they lie: (dim, ids, vocab, m, off, values, ...)."""
    kinds = [df.schema[c].dataType.simpleString() for c in df.columns]

    def block(t: pa.Table):
        t = t.combine_chunks()
        col = [t.column(i).chunk(0) for i in range(t.num_columns)]
        vocab, codes, off = _coded(col[1])
        values = col[2].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), one(col[0]), one(vocab), *[pa.array([x.tobytes()], pa.binary()) for x in (codes, off, values)], *[one(c) for c in col[3:]]], names=["dim", *names])

    def run(batches):
        held, n, size = [], 0, 0
        for b in batches:
            at, ends = 0, np.append(0, np.cumsum(_sizes(b.column(1))))
            while at < b.num_rows:
                width = ends[at:] - ends[at]
                take = max(1, min(b.num_rows - at, rows - n, int(np.searchsorted(width, entries - size, side="right")) - 1)) if n < rows else 0
                held.append(b.slice(at, take))
                n, size, at = n + take, size + int(width[take]), at + take
                if n >= rows or size >= entries or at < b.num_rows:
                    yield block(pa.Table.from_batches(held))
                    held, n, size = [], 0, 0
        if n:
            yield block(pa.Table.from_batches(held))

    more = "".join(f", {c} array<{k}>" for c, k in zip(names[5:], kinds[3:], strict=True))
    return df.mapInArrow(run, f"dim int, {names[0]} array<{kinds[0]}>, {names[1]} array<string>, {names[2]} binary, {names[3]} binary, {names[4]} binary{more}")


def _texts(x: pa.Scalar) -> list:
    return x.values.to_pylist()


def _numbers(x: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


class _Block:
    """Scores of one block of documents for one block of queries."""

    def __init__(self, row: dict, mean: float, k1: float, b: float):
        asked = row["_vocab"].values
        self.q_off, self.q_term = _numbers(row["_off"], np.int64), _numbers(row["_m"], np.int32).astype(np.int64)
        weight = np.zeros(len(asked))
        weight[self.q_term] = _numbers(row["_values"], np.float64)
        known = pc.index_in(row["vocab"].values, value_set=asked).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        off = _numbers(row["off"], np.int64)
        self.nq, self.nd, self.nt = len(self.q_off) - 1, len(off) - 1, len(asked)
        term = known[_numbers(row["m"], np.int32)] if len(known) else np.zeros(0, np.int64)
        doc, tf = np.repeat(np.arange(self.nd), np.diff(off)), _numbers(row["values"], np.float64)
        ok = term >= 0
        term, doc, tf = term[ok], doc[ok], tf[ok]
        dl = np.array(_texts(row["dl"]), np.float64)[doc]
        part = weight[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
        order = np.argsort(term, kind="stable")
        self.doc, self.part = doc[order], part[order]
        self.count = np.bincount(term, minlength=self.nt)
        self.start = np.append(0, np.cumsum(self.count))

    def stand(self, order: np.ndarray) -> None:
        """Documents take their places in this order."""
        place = np.empty(self.nd, np.int64)
        place[order] = np.arange(self.nd)
        self.doc = place[self.doc]

    def chunk(self, a: int, z: int) -> np.ndarray:
        """Scores of queries a to z of the block, all documents; 0 for no term in common."""
        n = z - a
        t, q = self.q_term[self.q_off[a] : self.q_off[z]], np.repeat(np.arange(n), np.diff(self.q_off[a : z + 1]))
        dense = np.bincount(t, minlength=self.nt) * self.count > DENSE * n * self.nd
        s = np.zeros((n, self.nd))
        rows = np.flatnonzero(dense)
        if len(rows):
            at = np.full(self.nt, -1)
            at[rows] = np.arange(len(rows))
            w, asks = np.zeros((len(rows), self.nd)), np.zeros((n, len(rows)))
            for i, r in enumerate(rows.tolist()):
                w[i, self.doc[self.start[r] : self.start[r + 1]]] = self.part[self.start[r] : self.start[r + 1]]
            asks[q[dense[t]], at[t[dense[t]]]] = 1.0
            s = asks @ w
        t, q = t[~dense[t]], q[~dense[t]]
        m = self.count[t]
        if m.sum():
            i = np.repeat(self.start[t] - np.append(0, np.cumsum(m)[:-1]), m) + np.arange(m.sum())
            s += np.bincount(np.repeat(q, m) * self.nd + self.doc[i], self.part[i], n * self.nd).reshape(n, self.nd)
        return s


def _first(q: np.ndarray, score: np.ndarray, name: np.ndarray, k: int):
    """The k best of each query, ties by name. Names are compared among ties only."""
    order = np.lexsort((-score, q))
    q, score, name = q[order], score[order], name[order]
    even = (q[1:] == q[:-1]) & (score[1:] == score[:-1])
    if even.any():
        ends = np.flatnonzero(np.diff(np.concatenate(([0], even.astype(np.int8), [0]))))
        for a, z in zip(ends[::2].tolist(), ends[1::2].tolist(), strict=True):
            name[a : z + 1] = np.sort(name[a : z + 1])
    at = np.arange(len(q)) - np.searchsorted(q, q)
    return q[at < k], score[at < k], name[at < k]


def scores(forward_rows: DataFrame, asked: DataFrame, mean: float, k1: float, b: float, k: int | None, windowed: bool = False) -> DataFrame:
    """(query_id, hash, score), scores in nine digits: what each task holds of the k best of each query; the caller merges them.

    asked(query_id, terms, idfs, ...): a row for each query. windowed: forward rows have start, end and _source, and asked
    lower, upper and source: a query sees only rows that it meets. Without k all pairs with a term in common. A task's
    state is k rows for each query of the blocks that it has met.
    """
    kind, id_kind = asked.schema["query_id"].dataType.simpleString(), forward_rows.schema["hash"].dataType.simpleString()
    spark, more = forward_rows.sparkSession, ("start", "end", "_source") if windowed else ()
    limits = [F.col("lower").alias("_lower"), F.col("upper").alias("_upper"), F.col("source").alias("_asked")] if windowed else []
    # Few tasks, so that few best are merged, but one a core.
    rows = forward_rows.select("hash", "terms", "tfs", "dl", *more).coalesce(max(1, spark.sparkContext.defaultParallelism))
    docs = _packed(rows, ("ids", "vocab", "m", "off", "values", "dl", *more), DOCS, ENTRIES)
    asked = cut(asked.select("query_id", "terms", "idfs", *limits))
    dealt = asked.repartition(max(1, -(-asked.count() // QUERIES)))
    right = _packed(dealt, ("_ids", "_vocab", "_m", "_off", "_values", *(("_lower", "_upper", "_asked") if windowed else ())), QUERIES, 1 << 22)
    met = matrix.meet(docs, right, ["dim"])
    names = met.columns

    def run(batches):
        held = {}  # (first query of the block, chunk): its best so far
        known = {}

        def table(ids, q, score, name):
            return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(name.tolist()), pa.array(score)], names=["query_id", "hash", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(i)[r] for i, c in enumerate(names)}
                block, asks = _Block(row, mean, k1, b), row["_ids"].values
                ids = np.array(_texts(row["ids"]), object)
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                block.stand(order)
                see = matrix.may_see(row)[:, order] if windowed else None
                key = asks[0].as_py()
                known.setdefault(key, asks)
                for a in range(0, block.nq, CHUNK):
                    z = min(block.nq, a + CHUNK)
                    s = block.chunk(a, z)
                    old = held.get((key, a))
                    if k is None or old is not None:
                        # A query that has k looks at what comes near its last only.
                        floor, worst, place = np.zeros(z - a), np.full(z - a, -1.0), np.zeros(z - a, np.int64)
                        if k is not None:
                            last = np.searchsorted(old[0], np.arange(z - a), side="right") - 1
                            full = np.flatnonzero(np.bincount(old[0], minlength=z - a) >= k)
                            worst[full], place[full] = old[1][last[full]], np.searchsorted(ids, old[2][last[full]])
                            floor[full] = np.maximum(worst[full] - 2e-9, 0.0)
                        q, d = np.nonzero(s > floor[:, None])
                        if see is not None:
                            may = see[a + q, d]
                            q, d = q[may], d[may]
                        score = np.round(s[q, d], 9)
                        if k is None:
                            if len(q):
                                yield table(asks, q + a, score, ids[d])
                            continue
                        take = (score > worst[q]) | (score == worst[q]) & (d < place[q])
                        if take.any():
                            best = (q[take], score[take], ids[d[take]])
                            held[key, a] = _first(*(np.concatenate(x) for x in zip(old, best, strict=True)), k)
                        continue
                    hit = s > 0
                    if see is not None:
                        hit &= see[a:z]
                    s = np.round(s, 9)
                    s[~hit] = -1.0
                    # The k best of the block: documents stand by name, so of equal scores the first are taken.
                    least = np.partition(s, -k, axis=1)[:, -k] if block.nd > k else np.full(z - a, -1.0)
                    more, even = s > least[:, None], hit & (s == least[:, None])
                    take = more | even & (np.cumsum(even, axis=1) <= (k - more.sum(axis=1))[:, None])
                    q, d = np.nonzero(take)
                    if len(q):
                        held[key, a] = _first(q, s[q, d], ids[d], k)
        for (key, a), (q, score, name) in held.items():
            if len(q):
                yield table(known[key], q + a, score, name)

    return met.mapInArrow(run, f"query_id {kind}, hash {id_kind}, score double")
