"""Substring dedup: passages that recur across documents, found by suffix arrays over the corpus's shared passages."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Work, group_seed, ids_of, mix64, pack, pieces, shards_for, texts_of, unpack
from .suffix_array import Words, common_prefixes, sort_directly, suffix_array

CHUNK = "gid bigint, body binary, probes array<struct<shard:int,entries:binary>>"
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_ODD = mix64(np.arange(1000, 1008, dtype=np.uint64)) | np.uint64(1)
#: Bytes of passages of a sorting shard that are sorted at once; a larger shard (a half that very many documents share) is sorted in parts.
WHOLE = 24 << 20
_PROBE = pa.list_(pa.struct([("shard", pa.int32()), ("entries", pa.binary())]))


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each position, by doubling: len(data) - k + 1 of them."""
    h, have, parts, at, bit = _BYTE[data], 1, [], 0, k
    while True:
        if bit & 1:
            parts.append((h, at))
            at += have
        bit >>= 1
        if not bit:
            break
        h = h[: len(h) - have] * _ODD[have.bit_length() % 8] + h[have:]
        have *= 2
    n = len(data) - k + 1
    out = np.zeros(n, np.uint64)
    for h, at in parts:
        out *= _ODD[7]
        out += h[at : at + n]
    return mix64(out)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours."""
    have, n = 1, len(h) - w + 1
    while have * 2 <= w:
        h = np.minimum(h[: len(h) - have], h[have:])
        have *= 2
    return np.minimum(h[:n], h[w - have : w - have + n])


def runs(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `length` bytes, grouped where neighbours have the same sampled half: (first, last, key, text number).

    A window's key is the smallest hash among its halves, so equal windows have equal keys wherever they stand.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none
    k = length // 2
    low = window_minima(rolling(data, k), length - k + 1)
    n = np.maximum(np.diff(off) - length + 1, 0)  # windows of each text
    use = np.flatnonzero(n)
    if not len(use):
        return none, none, none.astype(np.uint64), none
    edge = np.zeros(len(low) + 1, np.int8)
    edge[off[use]] += 1
    edge[off[use] + n[use]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    first = inside.copy()
    first[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    first[off[use]] = True
    begin = np.flatnonzero(first)
    text = np.searchsorted(off, begin, side="right") - 1
    # Texts without windows share an offset with none that has: the right-most text at an offset is the one with bytes.
    last = np.minimum(np.append(begin[1:] - 1, len(low) - 1), off[text] + n[text] - 1)
    return begin, last, low[begin], text


def _keys(key: np.ndarray, text: np.ndarray, ids: np.ndarray, n_shards: int):
    """Distinct keys by shard, as 32-bit numbers, and whether two documents of the chunk have the key."""
    order = np.argsort(key, kind="stable")
    k, d = key[order], ids[text[order]]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    twice = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at) if len(at) else np.zeros(0, bool)
    k = k[at]
    shard = (k % np.uint64(n_shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return k[order], shard[order], twice[order]


def _cuts(shard: np.ndarray) -> list[tuple[int, int]]:
    if not len(shard):
        return []
    cut = (np.flatnonzero(np.diff(shard)) + 1).tolist()
    return list(zip([0, *cut], [*cut, len(shard)], strict=True))


def _packed(keys: np.ndarray, twice: np.ndarray) -> bytes:
    """Ascending 32-bit keys as differences, byte by byte of these, with a bit for each key."""
    step = np.diff(keys, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
    return struct.pack("<I", len(keys)) + zstandard.ZstdCompressor(level=1).compress(step.tobytes() + np.packbits(twice).tobytes())


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", blob)[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), np.uint8)
    step = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view(np.uint32).reshape(-1)
    return np.cumsum(step, dtype=np.uint32), np.unpackbits(raw[4 * n :], count=n).astype(bool)


def _recurring(blobs: list[bytes]) -> list[bytes]:
    """For each chunk's keys a bit: another chunk, or another document of the chunk, has the key too."""
    parts = [_unpacked(b) for b in blobs]
    ids, where, count = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
    many = count > 1
    many[where[np.concatenate([p[1] for p in parts])]] = True
    many, at, out = many[where], 0, []
    for p, _ in parts:
        out.append(np.packbits(many[at : at + len(p)]).tobytes())
        at += len(p)
    return out


def _passages(batch: pa.RecordBatch, told: list[dict], length: int, n_shards: int, n_sorts: int):
    """The chunk's distinct recurring passages by sorting shard: (data, off, ids, run rows, passage of each, order, shard, bytes, owner)."""
    data, off = texts_of(batch, "text")
    ids = ids_of(batch, "doc_id")
    begin, last, key, text = runs(data, off, length)
    k, shard, _ = _keys(key, text, ids, n_shards)
    bits = {x["shard"]: x["bits"] for x in told}
    many = np.zeros(len(k), bool)
    for a, z in _cuts(shard):
        many[a:z] = np.unpackbits(np.frombuffer(bits[int(shard[a])], np.uint8), count=z - a)
    hot = np.sort(k[many])
    if len(hot):
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        pick = hot[at] == key
    else:
        pick = np.zeros(len(key), bool)
    begin, last, key, text = begin[pick], last[pick], key[pick], text[pick]
    raw, seen, number, owner, keys = data.tobytes(), {}, [], [], []
    for a, z, d, h in zip(begin.tolist(), (last + length).tolist(), ids[text].tolist(), key.tolist(), strict=True):
        p = raw[a:z]
        i = seen.setdefault(p, len(seen))
        if i == len(owner):
            owner.append(d)
            keys.append(h)
        elif d < owner[i]:
            owner[i] = d
        number.append(i)
    owner = np.array(owner, np.int64)
    shard = (mix64(np.array(keys, np.uint64)) % np.uint64(n_sorts)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return data, off, ids, (begin, last, text, np.array(number, np.int64)), list(seen), owner, order, shard[order]


def _repeated(texts: list[list[bytes]], owners: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Per chunk, a flag for each window of its passages: a smaller document holds the window."""
    least: dict[bytes, int] = {}
    for ps, os_ in zip(texts, owners, strict=True):
        for p, o in zip(ps, os_.tolist(), strict=True):
            if least.get(p, o) >= o:
                least[p] = o
    place, size = {}, np.array([len(p) for p in least], np.int64)
    start = np.append(0, np.cumsum(size))
    for i, p in enumerate(least):
        place[p] = int(start[i])
    data = np.frombuffer(b"".join(least), np.uint8)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, start[:-1], 1)
    np.add.at(edge, start[:-1] + size - length + 1, -1)
    wanted = np.cumsum(edge[:-1]) > 0
    first = np.full(len(data), np.iinfo(np.int64).max)
    sa = suffix_array(data, wanted, length)
    if len(sa):
        lcp = common_prefixes(data, sa, length)
        group = np.flatnonzero(lcp < length)
        holder = np.repeat(np.array(list(least.values()), np.int64), size)
        low = np.minimum.reduceat(holder[sa], group)
        first[sa] = np.repeat(low, np.diff(np.append(group, len(sa))))
    out = []
    for ps, os_ in zip(texts, owners, strict=True):
        if not ps:
            out.append(np.zeros(0, bool))
            continue
        n = np.array([len(p) - length + 1 for p in ps], np.int64)
        at = np.repeat(np.array([place[p] for p in ps], np.int64) - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        out.append(first[at] < np.repeat(os_, n))
    return out


def _parts(text: np.ndarray, start: np.ndarray, length: int, most: int, held: int = 8):
    """Positions of the passages' windows, about `most` at a time: dealt by a hash of the window, so equal ones come together; `held` parts are gathered in a pass."""
    size = np.diff(start) - length + 1
    done = np.append(0, np.cumsum(size))
    n = -(-int(done[-1]) // most)
    for low in range(0, n, held):
        got, part, a = [], [], 0
        while a < len(size):
            z = max(a + 1, int(np.searchsorted(done, done[a] + most // 4, side="right")) - 1)
            at = np.repeat(start[a:z] - (done[a:z] - done[a]), size[a:z]) + np.arange(done[z] - done[a])
            to = ((rolling(text[start[a] : start[z]], length)[at - start[a]] >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)
            mine = (to >= low) & (to < low + held)
            got.append(at[mine])
            part.append(to[mine])
            a = z
        at, part = np.concatenate(got), np.concatenate(part)
        order = np.argsort(part, kind="stable")
        yield from np.split(at[order], np.flatnonzero(np.diff(part[order])) + 1)


def _repeated_parts(blobs: list[bytes], length: int, most: int = 4 << 20) -> list[np.ndarray]:
    """The flags of _repeated for a shard of any size: beside the passages' bytes, only a part of the windows is in memory and sorted at once."""
    data, sizes, owners = bytearray(), [], []
    for x in blobs:
        r = unpack(x)
        p = r.column(0)
        off = np.frombuffer(p.buffers()[1], np.int32, len(p) + 1, p.offset * 4)
        data += memoryview(p.buffers()[2])[int(off[0]) : int(off[-1])]
        sizes.append(np.diff(off).astype(np.int64))
        owners.append(r.column(1).to_numpy())
    data += bytes(length + 16)
    text, owner = np.frombuffer(data, np.uint8), np.concatenate(owners)
    words, start = Words(text, length, padded=True), np.append(0, np.cumsum(np.concatenate(sizes)))
    flag = np.zeros(start[-1], bool)
    for part in _parts(text, start, length, most):
        if not len(part):
            continue
        sa = sort_directly(part, words)
        group = np.flatnonzero(common_prefixes(text, sa, length, words) < length)
        holder = owner[np.searchsorted(start, sa, side="right") - 1]
        flag[sa] = np.repeat(np.minimum.reduceat(holder, group), np.diff(np.append(group, len(sa)))) < holder
    out, at = [], 0
    for s in sizes:
        end = np.cumsum(s)
        edge = np.zeros(end[-1] + 1, np.int8)  # the last length - 1 places of a passage begin no window
        edge[end - length + 1] += 1
        edge[end] -= 1
        window = np.cumsum(edge[:-1], dtype=np.int8) == 0
        out.append(flag[at : at + len(window)][window])
        at += len(window)
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (bytes), spans (array of start, end).

    Removes each byte covered by a string of `length` bytes that also starts in a document with a smaller id; overlaps
    count, strings are judged on the input, and matches never cross documents. Texts are UTF-8 bytes, so what is kept
    may end inside a character. Null counts as empty, a null id is the smallest, rows repeated with one id match
    nothing of each other. An empty table gives no rows; further columns are ignored.

    Tasks pack documents into chunks and group a text's windows by a sampled half (the smallest hash among the halves
    of a window, the same for equal windows). Shards tell which keys recur; only the passages around these, each once
    for a chunk, go to sorting shards, where a two-stage suffix array and its adjacent common prefixes give every
    window's smallest document; a shard with more passages than are sorted at once sorts parts of the windows one after
    another. Chunks then mark their own bytes.
    """
    spark = docs.sparkSession
    work, n_shards = Work(spark, "substrings"), shards_for(docs)
    n_sorts = 2 * n_shards
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def send(batches):
        gid = group_seed()
        for b in pieces(batches, "text", 2 << 20):
            _, _, key, text = runs(*texts_of(b, "text"), length)
            k, shard, twice = _keys(key, text, ids_of(b, "doc_id"), n_shards)
            k = (k >> np.uint64(32)).astype(np.uint32)
            probes = [{"shard": int(shard[a]), "entries": _packed(k[a:z], twice[a:z])} for a, z in _cuts(shard)]
            yield pa.RecordBatch.from_arrays([pa.array([gid]), pa.array([pack(b)], pa.binary()), pa.array([probes], _PROBE)], names=["gid", "body", "probes"])
            gid += 1

    chunks = work.save(slim.mapInArrow(send, CHUNK), "chunks", packed=True)

    def recur(key, t):
        return pa.table({"gid": t["gid"], "shard": t["shard"], "bits": pa.array(_recurring(t["entries"].to_pylist()), pa.binary())})

    bits = work.save(chunks.select("gid", F.inline("probes")).groupBy("shard").applyInArrow(recur, "gid bigint, shard int, bits binary"), "bits")
    told = bits.groupBy("gid").agg(F.collect_list(F.struct("shard", "bits")).alias("told"))
    bodies = chunks.select("gid", "body")

    def pick(batches):
        for b in batches:
            for gid, body, told_ in zip(*(b.column(c).to_pylist() for c in ("gid", "body", "told")), strict=True):
                *_, texts, owner, order, shard = _passages(unpack(body), told_, length, n_shards, n_sorts)
                for a, z in _cuts(shard):
                    mine = order[a:z]
                    rows = pa.RecordBatch.from_arrays([pa.array([texts[i] for i in mine.tolist()], pa.binary()), pa.array(owner[mine])], names=["p", "o"])
                    size = sum(len(texts[i]) for i in mine.tolist())
                    yield pa.RecordBatch.from_arrays([pa.array([gid]), pa.array([int(shard[a])], pa.int32()), pa.array([size]), pa.array([pack(rows)], pa.binary())], names=["gid", "sort", "bytes", "passages"])

    picked = bodies.join(told.hint("merge"), "gid").mapInArrow(pick, "gid bigint, sort int, bytes bigint, passages binary")

    def sort(key, t):
        if t["bytes"].to_numpy().sum() > WHOLE:
            flags = _repeated_parts(t["passages"].to_pylist(), length)
        else:
            rows = [unpack(x) for x in t["passages"].to_pylist()]
            flags = _repeated([r.column(0).to_pylist() for r in rows], [r.column(1).to_numpy() for r in rows], length)
        return pa.table({"gid": t["gid"], "sort": t["sort"], "flags": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())})

    flags = picked.groupBy("sort").applyInArrow(sort, "gid bigint, sort int, flags binary").groupBy("gid").agg(F.collect_list(F.struct("sort", "flags")).alias("flags"))

    def apply(batches):
        for b in batches:
            for body, told_, flags_ in zip(*(b.column(c).to_pylist() for c in ("body", "told", "flags")), strict=True):
                yield _marked(unpack(body), told_ or [], {x["sort"]: x["flags"] for x in flags_ or ()}, length, n_shards, n_sorts)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<struct<start:bigint,end:bigint>>"
    return bodies.join(told.join(flags.hint("merge"), "gid", "left").hint("merge"), "gid", "left").select("body", "told", "flags").mapInArrow(apply, schema)


def _marked(batch: pa.RecordBatch, told: list[dict], flags: dict[int, bytes], length: int, n_shards: int, n_sorts: int) -> pa.RecordBatch:
    data, off, ids, (begin, last, text, number), texts, owner, order, shard = _passages(batch, told, length, n_shards, n_sorts)
    edge = np.zeros(len(data) + 1, np.int32)
    if len(begin):
        n = np.array([len(p) - length + 1 for p in texts], np.int64)
        at = np.append(0, np.cumsum(n))
        flag = np.zeros(at[-1], bool)
        for a, z in _cuts(shard):
            mine = order[a:z]
            got = np.unpackbits(np.frombuffer(flags[int(shard[a])], np.uint8), count=int(n[mine].sum())).astype(bool)
            to = np.repeat(at[mine] - np.append(0, np.cumsum(n[mine])[:-1]), n[mine]) + np.arange(len(got))
            flag[to] = got
        m = last - begin + 1
        step = np.arange(m.sum()) - np.repeat(np.append(0, np.cumsum(m)[:-1]), m)
        # A passage's later documents have a smaller one in their own chunk.
        gone = flag[np.repeat(at[number], m) + step] | np.repeat(ids[text] > owner[number], m)
        hit = (np.repeat(begin, m) + step)[gone]
        edge += np.bincount(hit, minlength=len(edge)).astype(np.int32) - np.bincount(hit + length, minlength=len(edge)).astype(np.int32)
    covered = np.cumsum(edge[:-1]) > 0
    first = covered.copy()
    if len(data):
        first[1:] &= ~covered[:-1]
        cuts = off[(off > 0) & (off < len(data))]
        first[cuts] = covered[cuts]
    gone = np.append(0, np.cumsum(covered))
    starts = np.flatnonzero(first)
    rank = np.searchsorted(starts, off)
    out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "spans": []}
    # A span ends where bytes stop being covered or the text ends.
    stop = np.flatnonzero(covered & ~np.append(covered[1:], False)) + 1 if len(data) else starts
    for d, a, z, i, j in zip(ids.tolist(), off[:-1].tolist(), off[1:].tolist(), rank[:-1].tolist(), rank[1:].tolist(), strict=True):
        s = starts[i:j]
        e = np.minimum(stop[np.searchsorted(stop, s, side="right")], z) if j > i else s
        out["doc_id"].append(None if d == NULL_ID else d)
        out["n_bytes"].append(z - a)
        out["n_removed"].append(int(gone[z] - gone[a]))
        out["n_spans"].append(j - i)
        out["kept"].append(data[a:z][~covered[a:z]].tobytes())
        out["spans"].append([{"start": x - a, "end": y - a} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
    return pa.RecordBatch.from_pydict(out, pa.schema([(c, pa.int64()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))
