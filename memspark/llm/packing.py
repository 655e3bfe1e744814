"""Best-fit packing of documents into fixed windows, where no window takes one source or one duplicate cluster twice."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work

#: Tokens of a window, and pieces that one task packs among themselves.
CAPACITY, SHARD = 2048, 4096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece, in the given order. sources, clusters: bit numbers, or -1 for none.

    Windows are kept by residual, and those with one residual by their bitmap of sources. From the piece's size upward,
    the successor search goes on until a window is found that has neither the piece's source nor its cluster.
    """
    by_room: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
    filled, rooms = 0, []  # bit r: some window has residual r
    source_map, cluster_map, window, offset = [], [], [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        s_bit, c_bit = (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        rest, found, room = filled >> size, -1, size
        while rest:
            step = (rest & -rest).bit_length() - 1
            room += step
            for bitmap, ids in by_room[room].items():
                if bitmap & s_bit:
                    continue
                found = next((k for k in range(len(ids) - 1, -1, -1) if not cluster_map[ids[k]] & c_bit), -1)
                if found >= 0:
                    b = ids.pop(found)
                    if not ids:
                        del by_room[room][bitmap]
                        if not by_room[room]:
                            filled &= ~(1 << room)
                    break
            if found >= 0:
                break
            rest, room = rest >> step + 1, room + 1
        if found < 0:
            b, room = len(rooms), capacity
            rooms.append(capacity)
            source_map.append(0)
            cluster_map.append(0)
        window.append(b)
        offset.append(capacity - room)
        room -= size
        rooms[b] = room
        source_map[b] |= s_bit
        cluster_map[b] |= c_bit
        by_room[room].setdefault(source_map[b], []).append(b)
        filled |= 1 << room
    return window, offset


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD, cluster_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, window, window_offset.

    Tokens are words [^\\x20\\x09-\\x0D]+. A document longer than a window fills windows of its own with its first pieces;
    its last piece, or the whole document, goes with others into the tightest window that has room and holds neither its
    source nor its duplicate cluster (texts that are equal in lower case, or equal values of cluster_col). A null source
    or a text without words conflicts with none; a text without words (null, empty) is a piece of 0 tokens. Nothing is
    dropped or cut off; rows repeated with one id are packed each. Pieces of one size go in the order of a hash of id and
    text, so that the result doesn't depend on how the rows lie in files. An empty table gives no rows; further columns,
    whatever their names, are ignored.

    Only ids and lengths are shuffled, by that hash into shards of about `shard_pieces` pieces, so a hot source is spread
    evenly, and so are equal rows, which are counted and dealt one by one. A window's number is its shard's number * 2^32
    + a count.
    """
    work = Work(docs.sparkSession, "packing")
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")).cast("long")
    cluster = F.xxhash64(F.col(cluster_col)) if cluster_col else F.xxhash64(F.lower(text))
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), n.alias("n"), F.when(n > 0, cluster).alias("cluster"), F.xxhash64(F.col(id_col).cast("long"), text).alias("uid"))
    rows = work.save(slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("copies")), "rows")
    n_shards = max(1, -(-(rows.agg(F.sum("copies")).first()[0] or 0) // shard_pieces))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))

    def run(key, t):
        # A full order, so that a retried task packs the same.
        t = t.take(pa.compute.sort_indices(t, [(c, "ascending") for c in ("uid", "doc_id", "copy", "source")]))
        ids, total, shard = t["doc_id"].to_pylist(), t["n"].to_numpy(), t["shard"][0].as_py()
        tail = np.where(total > 0, (total - 1) % capacity + 1, 0)
        order = np.argsort(-tail, kind="stable")
        s, c = (np.array(_codes(t[col].to_pylist()), np.int64) for col in ("source", "cluster"))
        window, offset = best_fit(tail[order].tolist(), s[order].tolist(), c[order].tolist(), capacity)
        out = {k: [] for k in ("doc_id", "piece", "start", "n_tokens", "window", "window_offset")}
        count = max(window, default=-1) + 1
        for k, w, o in zip(order.tolist(), window, offset, strict=True):
            full = int(total[k] - tail[k]) // capacity
            for p in range(full):
                _add(out, ids[k], p, p * capacity, capacity, (shard << 32) + count, 0)
                count += 1
            _add(out, ids[k], full, full * capacity, int(tail[k]), (shard << 32) + w, o)
        return pa.table(out, pa.schema([(k, pa.int64()) for k in out]))

    shard = F.pmod(F.xxhash64("doc_id", "uid", "copy"), F.lit(n_shards)).cast("long")
    return rows.withColumn("shard", shard).groupBy("shard").applyInArrow(run, "doc_id bigint, piece bigint, start bigint, n_tokens bigint, window bigint, window_offset bigint")


def _codes(values: list) -> list[int]:
    """Bit numbers of the shard's values, -1 for null and for values that stand alone: these conflict with nothing."""
    many = {v for v, n in Counter(values).items() if n > 1 and v is not None}
    seen: dict = {}
    return [seen.setdefault(v, len(seen)) if v in many else -1 for v in values]


def _add(out: dict, *row: int) -> None:
    for col, v in zip(out.values(), row, strict=True):
        col.append(v)
