"""Inverted-file index over vectors: trained cells, 8-bit residual codes, calibrated probes, exact rescoring."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.snapshot import cut, new_folder
from . import knn, matrix

#: Cells at most: their centroids are collected and sent to all tasks.
MOST_CELLS = 4096
#: Rows that one packed list holds, on average.
SLICE = 2048


LIST = "item_type string, ids array<string>, radius double, codes binary, lo binary, step binary"
VECTOR = "hash string, item_type string, embedding {}"


def kmeans(x: np.ndarray, cells: int, rounds: int = 25) -> np.ndarray:
    """Spherical k-means of unit rows, begun at evenly spaced rows; a cell without rows takes the row that fits its own worst."""
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    own = None
    for _ in range(rounds):
        s = x @ c.T
        new = s.argmax(axis=1)
        if own is not None and (new == own).all():
            break
        own = new
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        total[empty] = x[np.argsort(s[np.arange(len(x)), own], kind="stable")[: len(empty)]]
        length = np.sqrt((total * total).sum(axis=1))[:, None]
        c = np.divide(total, length, out=c.copy(), where=length > 0)
    return c


def train(vectors: DataFrame, dim: int, cells: int | None = None, sample: int = 10_000) -> tuple[np.ndarray, list[str]]:
    """(centroids, hashes of the sample): fitted on the `sample` rows with the smallest hash of their key, the same in every run."""
    rows = [(r.hash, r.embedding) for r in knn.training_sample(vectors.where(F.size("embedding") == dim), sample).select("hash", "embedding").collect()]
    if not rows:
        return np.zeros((1, dim)), []
    found = list(matrix.matrices(pa.array([e for _, e in rows], pa.list_(pa.float64())), dim))
    if not found:
        return np.zeros((1, dim)), []
    at, x = found[0]
    n = min(cells or MOST_CELLS, MOST_CELLS, len(x))
    return kmeans(x, n), [rows[i][0] for i in at]


@dataclass
class Index:
    """lists: (cell, item_type, ids, radius, codes, lo, step), packed and in one folder a cell; vectors: (cell, hash, item_type, embedding), likewise."""

    centroids: np.ndarray
    lists: DataFrame
    vectors: DataFrame
    probes: int
    dim: int
    path: str


def load(spark: SparkSession, path: str) -> Index:
    """An index that was written before."""
    meta = spark.read.parquet(f"{path}/meta").first()
    c = np.frombuffer(bytes(meta["centroids"]), np.float64).reshape(-1, meta["dim"])
    table = lambda name, ddl: spark.read.schema(f"{ddl}, cell int").parquet(f"{path}/{name}")
    return Index(c, table("lists", LIST), table("vectors", VECTOR.format(meta["kind"])), meta["probes"], meta["dim"], path)


def build(vectors: DataFrame, dim: int, path: str | None = None, cells: int | None = None, sample: int = 10_000, target: float = 0.95, k: int = 10, asked: int = 200) -> Index:
    """Indexes every valid row of vectors(hash, item_type, embedding) of the dimension.

    Cells (by default the square root of the rows, 4096 at most) are fitted on a sample of `sample` rows. The number of
    cells that a search probes is measured, not guessed: the fewest that hold `target` of the k nearest others of `asked`
    sampled rows, found by exact search over all rows. Where vectors have no clusters, that is most cells, and codes are
    what saves reading. A cell of any size is packed in slices of about SLICE rows.
    """
    spark = vectors.sparkSession
    path = path or new_folder(spark, "memspark_ivf")
    slim = vectors.select("hash", F.coalesce("item_type", F.lit("")).alias("item_type"), "embedding")
    if cells is None:
        cells = max(1, round(math.sqrt(slim.count())))
    c, hashes = train(slim, dim, cells, sample)
    sent = spark.sparkContext.broadcast(c.tobytes())

    def assign(batches):
        centers = np.frombuffer(sent.value, np.float64).reshape(-1, dim)
        for b in batches:
            for at, m in matrix.matrices(b.column(2), dim):
                rows = b.take(pa.array(at))
                cell = (m @ centers.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell)], names=["hash", "item_type", "embedding", "cell"])

    kind = slim.schema["embedding"].dataType.simpleString()
    held = slim.mapInArrow(assign, f"{VECTOR.format(kind)}, cell int")
    held.repartition(F.col("cell"), F.pmod(F.xxhash64("hash"), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/vectors")
    held = spark.read.schema(f"{VECTOR.format(kind)}, cell int").parquet(f"{path}/vectors")
    sizes = held.groupBy("cell", "item_type").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("_slices"))
    dealt = held.join(F.broadcast(sizes), ["cell", "item_type"]).withColumn("slice", F.pmod(F.xxhash64("hash"), F.col("_slices")).cast("int"))  # a row a cell and type

    def pack(key, t):
        t = t.sort_by("hash")
        (at, m), = matrix.matrices(t["embedding"].combine_chunks(), dim)
        cell = key[0].as_py()
        center = np.frombuffer(sent.value, np.float64).reshape(-1, dim)[cell]
        codes, lo, step = encode(m - center)
        return pa.table({
            "cell": pa.array([cell], pa.int32()), "item_type": [key[1].as_py()], "ids": [t["hash"].take(pa.array(at)).to_pylist()], "radius": [float((m @ center).min())],
            "codes": pa.array([codes.tobytes()], pa.binary()), "lo": pa.array([lo.tobytes()], pa.binary()), "step": pa.array([step.tobytes()], pa.binary()),
        })

    packed = dealt.groupBy("cell", "item_type", "slice").applyInArrow(pack, f"cell int, {LIST}")
    packed.write.partitionBy("cell").parquet(f"{path}/lists")
    probes = calibrate(held, c, hashes[:asked], k, target)
    meta = spark.createDataFrame([(dim, probes, kind, bytearray(c.tobytes()))], "dim int, probes int, kind string, centroids binary")
    meta.write.parquet(f"{path}/meta")
    return load(spark, path)


def encode(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, lo, step) of rows: 256 levels between each row's smallest and largest value."""
    lo, hi = residual.min(axis=1), residual.max(axis=1)
    step = np.where(hi > lo, (hi - lo) / 255, 1.0)
    return np.rint((residual - lo[:, None]) / step[:, None]).astype(np.uint8), lo.astype(np.float32), step.astype(np.float32)


def calibrate(held: DataFrame, c: np.ndarray, hashes: list[str], k: int, target: float) -> int:
    """The fewest probes that reach `target` of the k nearest others of the given rows."""
    if not hashes:
        return 1
    some = held.where(F.col("hash").isin(hashes)).select(F.col("hash").alias("query_id"), "embedding")
    near = knn.search(held, some, k + 1).where("hash != query_id").select("query_id", "hash")
    cells = {(r.query_id, r.hash): r.cell for r in near.join(held.select("hash", "cell"), "hash").collect()}
    asked = {r.query_id: r.embedding for r in some.collect()}
    names = sorted(asked)
    (at, m), = matrix.matrices(pa.array([asked[x] for x in names], pa.list_(pa.float64())), c.shape[1])
    place = np.argsort(np.argsort(-(m @ c.T), axis=1, kind="stable"), axis=1)
    row = {names[i]: n for n, i in enumerate(at.tolist())}
    ranks = np.sort([place[row[q], cell] for (q, _), cell in cells.items()])
    return int(ranks[max(0, math.ceil(target * len(ranks)) - 1)]) + 1 if len(ranks) else 1


def probe(index: Index, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """(query_id, cell, q): the cells that each valid query looks into, nearest first."""
    n, dim, kind = min(probes or index.probes, len(index.centroids)), index.dim, queries.schema["query_id"].dataType.simpleString()
    sent = queries.sparkSession.sparkContext.broadcast(index.centroids.tobytes())

    def run(batches):
        c = np.frombuffer(sent.value, np.float64).reshape(-1, dim)
        for b in batches:
            for at, m in matrix.matrices(b.column(1), dim):
                near = np.argsort(-(m @ c.T), axis=1, kind="stable")[:, :n].astype(np.int32)
                ids = b.column(0).take(pa.array(np.repeat(at, n)))
                q = pa.array([x.tobytes() for x in m], pa.binary()).take(pa.array(np.repeat(np.arange(len(m)), n)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(near.ravel()), q], names=["query_id", "cell", "q"])

    return queries.select("query_id", "embedding").mapInArrow(run, f"query_id {kind}, cell int, q binary")


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None, item_type: str | None = None, rescore: int = 4) -> DataFrame:
    """(query_id, hash, score, rank): the k best by exact cosine among what the probed cells' codes rank highest.

    Only the folders of probed cells are read. Codes of a slice meet the queries that probe its cell as one matrix
    product; the best k * rescore of a query are scored again over whole vectors. A hot cell is as many tasks as it has
    slices, and queries of one cell go in parts.
    """
    dim, wide = index.dim, k * rescore
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = probe(index, queries, probes)
    cells = sorted(r.cell for r in asked.select("cell").distinct().collect())  # MOST_CELLS at most
    lists, vectors = (t.where(F.col("cell").isin(cells)) if item_type is None else t.where(F.col("cell").isin(cells) & (F.col("item_type") == item_type)) for t in (index.lists, index.vectors))
    sent = queries.sparkSession.sparkContext.broadcast(index.centroids.tobytes())

    def pack(key, t):
        rows = t["q"].to_pylist()
        parts = range(0, len(rows), matrix.ROWS // 4)
        ids = t["query_id"].to_pylist()
        return pa.table([pa.array([key[0].as_py()] * len(parts), pa.int32()), pa.array([ids[i : i + matrix.ROWS // 4] for i in parts], pa.list_(t["query_id"].type)), pa.array([b"".join(rows[i : i + matrix.ROWS // 4]) for i in parts], pa.binary())], ["cell", "_ids", "_m"])

    parts = max(1, -(-asked.count() // (len(cells) * 20_000))) if cells else 1
    together = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).groupBy("cell", "part").applyInArrow(pack, f"cell int, _ids array<{kind}>, _m binary")

    def kernel(row):
        cell, ids, asked_ = row["cell"].as_py(), row["ids"].values, row["_ids"].values
        q = matrix.matrix(row["_m"], dim)
        center = np.frombuffer(sent.value, np.float64).reshape(-1, dim)[cell]
        codes = matrix.matrix(row["codes"], dim, np.uint8).astype(np.float32)
        lo, step = (np.frombuffer(row[x].as_buffer(), np.float32) for x in ("lo", "step"))
        s = (q @ center)[:, None] + q.sum(axis=1)[:, None] * lo + (q.astype(np.float32) @ codes.T) * step
        if s.shape[1] > wide:
            top = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
        else:
            top = np.broadcast_to(np.arange(s.shape[1]), s.shape)
        a = np.repeat(np.arange(len(q)), top.shape[1])
        b = top.ravel()
        again = pa.array([x.tobytes() for x in q], pa.binary()).take(pa.array(a))
        return pa.table([asked_.take(pa.array(a)), ids.take(pa.array(b)), pa.array(np.full(len(a), cell, np.int32)), pa.array(s[a, b].astype(np.float64)), again], ["query_id", "hash", "cell", "near", "q"])

    met = matrix.meet(lists.withColumn("m", F.col("codes")), together, ["cell"])
    rough = matrix.pairs(met, kernel, f"query_id {kind}, hash string, cell int, near double, q binary")
    w = Window.partitionBy("query_id")
    rough = rough.withColumn("_n", F.row_number().over(w.orderBy(F.desc("near"), "hash"))).where(F.col("_n") <= wide).drop("_n", "near")
    whole = rough.join(vectors.select("cell", "hash", "embedding"), ["cell", "hash"]).select("query_id", "hash", "q", "embedding")

    def again(batches):
        for b in batches:
            for at, m in matrix.matrices(b.column(3), dim):
                q = np.frombuffer(b"".join(b.column(2).take(pa.array(at)).to_pylist()), np.float64).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(matrix.exact(q, m))], names=["query_id", "hash", "score"])

    scored = whole.mapInArrow(again, f"query_id {kind}, hash string, score double")
    return scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "hash"))).where(F.col("rank") <= k)


def similar(index: Index, threshold: float = 0.85) -> DataFrame:
    """(src, dst, score): all pairs of indexed rows with threshold <= cosine < 1, each once.

    Rows go in blocks by cell, and each two blocks meet once: what is shuffled grows with rows, not with rows times cells.
    Exact: the angle to a centroid differs by no more than the angle between two rows, so of a block a row meets only
    those cells whose farthest row is near enough. Where vectors have no clusters, all blocks are multiplied.
    """
    dim, spark = index.dim, index.vectors.sparkSession
    reach = index.lists.groupBy("cell").agg(F.min("radius").alias("radius")).collect()  # MOST_CELLS at most
    far = np.full(len(index.centroids), 9.0)
    for r in reach:
        far[r.cell] = np.arccos(np.clip(r.radius, -1, 1))
    sent = spark.sparkContext.broadcast((index.centroids.tobytes(), far.tobytes()))
    limit = math.acos(threshold) + 1e-6
    rows = index.vectors.select("cell", "hash", "embedding")
    n = max(1, math.ceil(rows.count() / (0.75 * matrix.ROWS)))  # most parts are one block
    near = rows.repartitionByRange(n, "cell", "hash").sortWithinPartitions("cell", "hash")
    homes = cut(matrix.blocks(near, "hash", dim, more=("cell",)))  # both sides must have the same blocks
    met = matrix.meet(homes, homes.withColumnsRenamed({"ids": "_ids", "m": "_m", "cell": "_cell"}), ["dim"])
    met = met.where(F.struct("ids", "m") <= F.struct(F.col("_ids").alias("ids"), F.col("_m").alias("m")))

    def kernel(row):
        body, wide = sent.value
        c, far_ = np.frombuffer(body, np.float64).reshape(-1, dim), np.frombuffer(wide, np.float64)
        q, v = matrix.matrix(row["_m"], dim), matrix.matrix(row["m"], dim)
        cells, own = np.unique(np.array(row["cell"].values), return_inverse=True)
        may = np.arccos(np.clip(q @ c[cells].T, -1, 1)) <= far_[cells] + limit
        if may.mean() > 0.5:
            a, b = np.nonzero(q @ v.T >= threshold - matrix.SLACK)
        else:
            parts = [(np.zeros(0, np.int64),) * 2]
            for i in np.flatnonzero(may.any(axis=0)):
                x, y = np.flatnonzero(may[:, i]), np.flatnonzero(own == i)
                k, m = np.nonzero(q[x] @ v[y].T >= threshold - matrix.SLACK)
                parts.append((x[k], y[m]))
            a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        one, two = row["_ids"].values.take(pa.array(a)), row["ids"].values.take(pa.array(b))
        score = matrix.exact(q[a], v[b])
        itself = row["ids"].equals(row["_ids"]) and row["m"].equals(row["_m"])
        ok = pc.and_(pc.less(one, two) if itself else pc.not_equal(one, two), pa.array((score >= threshold) & (score < 1 - 1e-12)))
        less = pc.less(one, two)
        return pa.table([pc.if_else(less, one, two), pc.if_else(less, two, one), pa.array(score)], ["src", "dst", "score"]).filter(ok)

    return matrix.pairs(met, kernel, "src string, dst string, score double")


def synonyms(vectors: DataFrame, threshold: float = 0.85, dim: int | None = None) -> DataFrame:
    """Pairs of names with threshold <= similarity < 1, each once, exactly. Lengths are compared among themselves."""
    spark, rows = vectors.sparkSession, vectors.select("hash", F.lit("").alias("item_type"), "embedding")
    dims = [dim] if dim else [r[0] for r in rows.select(F.size("embedding")).distinct().where("size(embedding) > 0").collect()]
    out = spark.createDataFrame([], "src string, dst string, score double")
    for d in dims:
        out = out.unionByName(similar(build(rows, d, asked=0), threshold))
    return out
