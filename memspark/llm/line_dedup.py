"""Line dedup: documents probe sharded minimal-perfect-hash arrays of the corpus's lines."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS, Work, clean_columns, group_seed, ids_of, pack, pieces, put, shards_for, texts_of, unpack
from .mph import MinimalPerfectHash

ENTRY = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("first", "<i8"), ("last", "<i8"), ("docs", "<u4")])
CHUNK = "gid bigint, body binary, probes array<struct<shard:int,entries:binary>>"
KEEP, ONLY_FIRST, NOWHERE = 0, 1, 2
#: Bytes of an index that is sent to all tasks.
SENT = 32 << 20


def _keys(data: memoryview, off: np.ndarray, min_chars: int):
    """Per document: its lines, and each line's 16-byte key or None if the key is short."""
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        lines = bytes(data[a:b]).split(b"\n")
        keys = []
        for line in lines:
            k = line.strip(WS).lower()
            n = len(k)
            long = n >= min_chars and (n >= 4 * min_chars or len(k.decode("utf-8", "replace")) >= min_chars)
            keys.append(xxhash.xxh3_128_digest(k) if long else None)
        yield lines, keys


def _held(batch: pa.RecordBatch, id_col: str, text_col: str, min_chars: int):
    """The chunk's documents, and key -> [smallest id, largest id, documents], in order of appearance."""
    data, off = texts_of(batch, text_col)
    ids, docs, held = ids_of(batch, id_col).tolist(), [], {}
    for i, (lines, keys) in zip(ids, _keys(data.data, off, min_chars), strict=True):
        docs.append((i, lines, keys))
        for k in set(keys):
            if k is None:
                continue
            e = held.get(k)
            if e is None:
                held[k] = [i, i, 1]
            else:
                e[0], e[1], e[2] = min(e[0], i), max(e[1], i), e[2] + 1
    return docs, dict(sorted(held.items()))


def _by_shard(held: dict, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of (shard, key), the shard of each, and the order that takes `held` there."""
    e = np.zeros(len(held), ENTRY)
    raw = np.frombuffer(b"".join(held), "<u8").reshape(-1, 2)
    e["hi"], e["lo"] = raw[:, 0], raw[:, 1]
    if len(held):
        values = np.array(list(held.values()), np.int64)
        e["first"], e["last"], e["docs"] = values[:, 0], values[:, 1], values[:, 2]
    shard = (e["hi"] % np.uint64(n_shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return e[order], shard[order], order


class Shard:
    """A shard of the index: a minimal perfect hash over the lines that recur, with arrays of fingerprints, counts and first documents."""

    def __init__(self, arrays):
        self.mph = MinimalPerfectHash.restored(arrays)
        self.prints, self.counts, self.firsts = arrays["prints"], arrays["lines"], arrays["firsts"]
        odd = zip(arrays["odd_hi"].tolist(), arrays["odd_lo"].tolist(), arrays["odd_first"].tolist(), strict=True)
        self.odd = {(h, x): f for h, x, f in odd}

    @classmethod
    def read(cls, body: bytes) -> Shard:
        return cls(np.load(io.BytesIO(body)))

    def states(self, e: np.ndarray) -> np.ndarray:
        """For each entry of a chunk: KEEP if its line doesn't recur, ONLY_FIRST if the chunk holds its first document, else NOWHERE."""
        state = np.zeros(len(e), np.uint8)
        if len(self.prints) and len(e):
            i = self.mph.index(e["hi"])
            known = (i >= 0) & (self.prints[i] == e["lo"])
            state[known] = np.where(self.firsts[i[known]] == e["first"][known], ONLY_FIRST, NOWHERE)
        for k in range(len(e)) if self.odd else ():
            f = self.odd.get((int(e["hi"][k]), int(e["lo"][k])))
            if f is not None:
                state[k] = ONLY_FIRST if f == e["first"][k] else NOWHERE
        return state


def build_shard(tables: list[bytes]) -> bytes:
    """The index of a shard from its chunks' entries, by scatter: nothing is sorted.

    A first hash over all distinct lines gives each a place, at which counts are added up and the smallest and largest
    document are kept; the lines that more than one document holds go into the index under a hash of their own. Lines that
    share 64 bits with another are kept apart by all 128.
    """
    e = np.concatenate([np.frombuffer(t, ENTRY) for t in tables])
    hi = e["hi"]
    first_hash = MinimalPerfectHash(pa.array(hi).unique().to_numpy(zero_copy_only=False))
    n, place = first_hash.n, first_hash.index(hi)
    prints, keys = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    prints[place], keys[place] = e["lo"], hi
    odd = prints[place] != e["lo"]
    at, some = place[~odd], e[~odd]
    low, high, lines = np.full(n, 2**63 - 1, np.int64), np.full(n, -(2**63), np.int64), np.zeros(n, np.int64)
    np.minimum.at(low, at, some["first"])
    np.maximum.at(high, at, some["last"])
    np.add.at(lines, at, some["docs"].astype(np.int64))
    apart: dict[tuple[int, int], list[int]] = {}
    for h, x, a, z in e[odd][["hi", "lo", "first", "last"]].tolist():
        known = apart.setdefault((h, x), [a, z])
        known[:] = min(known[0], a), max(known[1], z)
    twice = low < high
    mph = MinimalPerfectHash(keys[twice])
    to = mph.index(keys[twice])
    out = {c: np.zeros(mph.n, kind) for c, kind in (("prints", np.uint64), ("lines", np.uint32), ("firsts", np.int64))}
    out["prints"][to], out["lines"][to], out["firsts"][to] = prints[twice], np.minimum(lines[twice], 2**32 - 1), low[twice]
    more = [(h, x, a) for (h, x), (a, z) in apart.items() if a < z]
    odd_ = {"odd_hi": np.array([m[0] for m in more], np.uint64), "odd_lo": np.array([m[1] for m in more], np.uint64), "odd_first": np.array([m[2] for m in more], np.int64)}
    sink = io.BytesIO()
    np.savez(sink, **mph.arrays(), **out, **odd_)
    return sink.getvalue()


@dataclass
class LineIndex:
    """The written index: table (shard, body), a row for each of n_shards that has entries."""

    table: DataFrame
    n_shards: int
    min_chars: int


def _by_chunk(batch: pa.RecordBatch, id_col: str, text_col: str, min_chars: int, n_shards: int):
    """The chunk's documents and lines, its entries by shard [(shard, entries)], and the lines' keys in that order."""
    found, held = _held(batch, id_col, text_col, min_chars)
    e, shard, order = _by_shard(held, n_shards)
    cut = np.flatnonzero(np.diff(shard)) + 1
    parts = [(int(shard[a]), e[a:z]) for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(e)], strict=True)] if len(e) else []
    names = list(held)
    return found, parts, [names[k] for k in order.tolist()], held


def _left(batch: pa.RecordBatch, found, names: list, states: np.ndarray, held: dict, text_col: str) -> pa.RecordBatch:
    """The chunk's rows without the lines that go."""
    gone = {k: (s, held[k][0]) for k, s in zip(names, states.tolist(), strict=True) if s != KEEP}
    texts, n_lines, n_dropped = [], [], []
    for i, lines, ks in found:
        left = [x for x, k in zip(lines, ks, strict=True) if (s := gone.get(k)) is None or s[0] == ONLY_FIRST and s[1] == i]
        texts.append(b"\n".join(left).decode("utf-8", "replace"))
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(left))
    return put(batch, **{text_col: pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})


def index_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> LineIndex:
    """The index of all lines that recur in docs: chunks send their distinct lines, once each, to shards by hash, and each shard writes its arrays."""
    work, n_shards = Work(docs.sparkSession, "lines"), shards_for(docs)

    def send(batches):
        for b in pieces(batches, text_col):
            for s, e in _by_chunk(b, id_col, text_col, min_chars, n_shards)[1]:
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([e.tobytes()], pa.binary())], names=["shard", "entries"])

    def build(key, t):
        return pa.table({"shard": t["shard"][:1], "body": pa.array([build_shard(t["entries"].to_pylist())], pa.binary())})

    sent = docs.select(id_col, text_col).mapInArrow(send, "shard int, entries binary").repartition(n_shards, "shard")
    return LineIndex(work.save(sent.groupBy("shard").applyInArrow(build, "shard int, body binary"), "index"), n_shards, min_chars)


def drop_lines(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, of the index's own documents or others, without the lines that the index says an earlier document has.

    An index of at most SENT bytes is sent to all tasks, and documents probe it where they lie. A larger one stays where it
    is: each chunk's distinct lines go to their shards, are probed there, and a state a line comes back. Both give the same.
    """
    spark, n_shards, min_chars = docs.sparkSession, index.n_shards, index.min_chars
    docs = clean_columns(docs, "n_lines", "n_dropped")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    size = index.table.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    if size <= SENT:
        sent = spark.sparkContext.broadcast({r.shard: bytes(r.body) for r in index.table.collect()})

        def probe(batches):
            shards = {s: Shard.read(b) for s, b in sent.value.items()}
            none = lambda e: np.zeros(len(e), np.uint8)
            for b in pieces(batches, text_col):
                found, parts, names, held = _by_chunk(b, id_col, text_col, min_chars, n_shards)
                states = [shards[s].states(e) if s in shards else none(e) for s, e in parts]
                yield _left(b, found, names, np.concatenate(states) if states else np.zeros(0, np.uint8), held, text_col)

        return docs.mapInArrow(probe, schema)
    work = Work(spark, "probe")

    def send(batches):
        gid = group_seed()
        for b in pieces(batches, text_col):
            probes = [{"shard": s, "entries": e.tobytes()} for s, e in _by_chunk(b, id_col, text_col, min_chars, n_shards)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([gid]), pa.array([pack(b)], pa.binary()), pa.array([probes], pa.list_(pa.struct([("shard", pa.int32()), ("entries", pa.binary())])))], names=["gid", "body", "probes"])
            gid += 1

    chunks = work.save(docs.mapInArrow(send, CHUNK), "chunks", packed=True)

    def answer(key, probes, shard):
        if not probes.num_rows:
            return pa.table({"gid": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()), "states": pa.array([], pa.binary())})
        arrays = Shard.read(shard["body"][0].as_py()) if shard.num_rows else None
        blobs = [np.frombuffer(t, ENTRY) for t in probes["entries"].to_pylist()]
        states = [arrays.states(e).tobytes() if arrays else bytes(len(e)) for e in blobs]
        return pa.table({"gid": probes["gid"], "shard": probes["shard"], "states": pa.array(states, pa.binary())})

    routed = chunks.select("gid", F.inline("probes")).repartition(n_shards, "shard").groupBy("shard")
    answers = work.save(routed.cogroup(index.table.groupBy("shard")).applyInArrow(answer, "gid bigint, shard int, states binary"), "answers")
    told = answers.groupBy("gid").agg(F.collect_list(F.struct("shard", "states")).alias("told"))

    def apply(batches):
        for b in batches:
            for body, told in zip(b.column("body").to_pylist(), b.column("told").to_pylist(), strict=True):
                rows = unpack(body)
                found, _, names, held = _by_chunk(rows, id_col, text_col, min_chars, n_shards)
                states = np.frombuffer(b"".join(x["states"] for x in sorted(told or (), key=lambda x: x["shard"])), np.uint8)
                yield _left(rows, found, names, states, held, text_col)

    return chunks.select("gid", "body").join(told.hint("merge"), "gid", "left").select("body", "told").mapInArrow(apply, schema)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """The input's rows and columns with the text that is left, and n_lines, n_dropped.

    A text is split at \\n; null counts as empty, one empty line. A line's key is the line stripped of ASCII white
    space at both ends with A-Z lower-cased. Lines whose key has at least `min_chars` code points and occurs in two or
    more documents stay only in the document with the smallest id; there all of them stay. Rows with one id are one
    document; a null id is the smallest. Order, blank lines and all other lines stay. Input columns named like a result
    column are replaced. An empty table gives no rows.

    The lines that recur are indexed first (index_lines), then the documents probe the written index (drop_lines). A line
    that a third of all documents hold costs one entry for each chunk.
    """
    return drop_lines(docs, index_lines(docs, id_col, text_col, min_chars), id_col, text_col)
