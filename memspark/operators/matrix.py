"""Vectors in blocks: matrix products over packed rows, for exact and for indexed search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshot import cut

#: Rows of a block, and bytes of blocks that are sent to all tasks; more blocks are dealt by a grid.
ROWS, SENT = 2048, 64 << 20
#: A product's rounding; what is nearer than this to the last place is scored again, term by term in one order.
SLACK = 1e-9
SCORED = "score double"


def matrices(col: pa.Array, dim: int | None = None):
    """(rows, matrix) of each length: valid vectors (not null or empty, all finite, of the dimension) at unit length, as doubles; a zero vector stays."""
    if not len(col):
        return
    col = pa.ListArray.from_arrays(col.offsets, col.values, mask=col.is_null()) if col.null_count else col
    size = np.nan_to_num(np.asarray(pc.list_value_length(col).fill_null(0)), nan=0).astype(np.int64)
    off = np.asarray(col.offsets).astype(np.int64)
    flat = pc.cast(col.values, pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    for n in sorted(set(size.tolist()) - {0}):
        if dim is not None and n != dim:
            continue
        rows = np.flatnonzero(size == n)
        m = flat[off[rows][:, None] + np.arange(n)]
        ok = np.isfinite(m).all(axis=1)
        rows, m = rows[ok], np.ascontiguousarray(m[ok])
        length = np.sqrt((m * m).sum(axis=1))
        yield rows, np.divide(m, length[:, None], out=m.copy(), where=length[:, None] > 0)


def blocks(df: DataFrame, key: str, dim: int | None = None, rows: int = ROWS, more: tuple[str, ...] = ()) -> DataFrame:
    """(dim, ids, m, ...): the valid vectors of df(key, embedding, ...), packed where they lie with the columns in `more` as arrays; nothing is shuffled."""
    kinds = [df.schema[c].dataType.simpleString() for c in (key, *more)]

    def run(batches):
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in (key, *more)]
            for at, m in matrices(b.column(b.schema.get_field_index("embedding")), dim):
                for k in range(0, len(at), rows):
                    take = pa.array(at[k : k + rows])
                    packed = [pa.array([c.take(take).to_pylist()], pa.list_(c.type)) for c in cols]
                    yield pa.RecordBatch.from_arrays([pa.array([m.shape[1]], pa.int32()), packed[0], pa.array([m[k : k + rows].tobytes()], pa.binary()), *packed[1:]], names=["dim", "ids", "m", *more])

    extra = "".join(f", {c} array<{k}>" for c, k in zip(more, kinds[1:], strict=True))
    return df.select(key, "embedding", *more).mapInArrow(run, f"dim int, ids array<{kinds[0]}>, m binary{extra}")


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Products of paired rows, each summed in the same order, so that equal vectors have equal scores."""
    return (q * v).sum(axis=1)


def best(q: np.ndarray, v: np.ndarray, names: np.ndarray, k: int, may: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): for each row of q its k best rows of v, of those that it may see; ties go to the smaller name."""
    s = q @ v.T
    if may is not None:
        s[~may] = -np.inf
    least = np.partition(s, -k, axis=1)[:, -k] if v.shape[0] > k else np.full(len(q), -np.inf)
    a, b = np.nonzero((s >= least[:, None] - SLACK) & np.isfinite(s))
    score = exact(q[a], v[b])
    order = np.lexsort((names[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    first = np.searchsorted(a, np.arange(q.shape[0]))
    keep = np.arange(len(a)) - first[a] < k
    return a[keep], b[keep], score[keep]


def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left x right on equal keys. right (queries) is written and sent to all tasks up to SENT bytes; beyond, both are dealt to a grid: no task gets all of a key."""
    right = cut(right)
    size = right.agg(F.sum(F.octet_length("_m"))).first()[0] or 0
    if size <= SENT:
        return left.join(F.broadcast(right), on)
    side = max(2, int(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    row, col = F.pmod(F.xxhash64("ids", "m"), F.lit(side)), F.pmod(F.xxhash64("_ids", "_m"), F.lit(side))
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    a = left.withColumn("_row", row.cast("int")).select("*", every.alias("_col"))
    b = right.withColumn("_col", col.cast("int")).select("*", every.alias("_row"))
    return a.join(b.hint("merge"), [*on, "_row", "_col"])


def pairs(met: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """kernel(row of packed blocks) -> arrays, for each row that meet() gives."""
    names = met.columns

    def run(batches):
        out = None
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(i)[k] for i, c in enumerate(names)}
                out = kernel(row)
                if out.num_rows:
                    yield from out.to_batches()

    return met.mapInArrow(run, schema)


def matrix(x: pa.Scalar, dim: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind).reshape(-1, dim)


def may_see(row: dict) -> np.ndarray:
    """Which rows of a block lie in the window and source of which queries."""
    column = lambda c, kind: np.array(row[c].values.to_pylist(), kind)
    start, end, lower, upper = (column(c, float) for c in ("start", "end", "_lower", "_upper"))  # null is nan
    with np.errstate(invalid="ignore"):
        ok = (np.isnan(lower)[:, None] | (end >= lower[:, None])) & (np.isnan(upper)[:, None] | (start <= upper[:, None]))
    asked, have = column("_asked", object), column("_source", object)
    names = {x: n for n, x in enumerate(dict.fromkeys([*asked, *have]))}
    a, b = (np.array([names[x] for x in xs], np.int64) for xs in (asked, have))
    free = np.array([x is None for x in asked], bool)
    return ok & (free[:, None] | (a[:, None] == b))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, dim: int | None = None, windowed: bool = False) -> DataFrame:
    """(query_id, hash, score): the k best of each pair of blocks, by cosine in double precision; the caller merges them.

    windowed: vectors have start, end and _source, and queries lower, upper and source, each its own; a query sees only
    rows that it meets.
    """
    kind, name = queries.schema["query_id"].dataType.simpleString(), vectors.schema["hash"].dataType.simpleString()
    if windowed:
        queries = queries.select("query_id", "embedding", F.col("lower").alias("_lower"), F.col("upper").alias("_upper"), F.col("source").alias("_asked"))
    q = blocks(queries, "query_id", dim, ROWS // 4, ("_lower", "_upper", "_asked") if windowed else ()).withColumnsRenamed({"ids": "_ids", "m": "_m"})

    def kernel(row):
        d = row["dim"].as_py()
        ids, asked = row["ids"].values, row["_ids"].values
        a, b, score = best(matrix(row["_m"], d), matrix(row["m"], d), np.array(ids.to_pylist()), k, may_see(row) if windowed else None)
        return pa.table([asked.take(pa.array(a)), ids.take(pa.array(b)), pa.array(score)], ["query_id", "hash", "score"])

    v = blocks(vectors, "hash", dim, ROWS, ("start", "end", "_source") if windowed else ())
    return pairs(meet(v, q, ["dim"]), kernel, f"query_id {kind}, hash {name}, {SCORED}")


def scored(rows: DataFrame, keys: tuple[str, ...], a: str = "a", b: str = "b") -> DataFrame:
    """rows with `score`, the cosine of the vectors in a and b; rows where either is invalid, or lengths differ, go."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches):
        for x in batches:
            left, right = (dict((n, (r, m)) for n, m, r in ((m.shape[1], m, r) for r, m in matrices(x.column(i)))) for i in (0, 1))
            for n in left.keys() & right.keys():
                at = np.intersect1d(left[n][0], right[n][0])
                p, q = (side[n][1][np.searchsorted(side[n][0], at)] for side in (left, right))
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at)) for c in x.columns[2:]], pa.array(exact(p, q))], names=[*keys, "score"])

    return rows.select(a, b, *keys).mapInArrow(run, f"{kinds}, {SCORED}")
