"""MinHash near-dedup over an LSH forest, with links confirmed on full shingle sets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Work, group_seed, ids_of, mix64, pack, pieces, shards_for, texts_of, unpack
from .components import components
from .shingles import shingle_sets

#: Sorted orders, and the depth from which neighbours with a common prefix are candidates. Regions larger than
#: CROWD[0] rows go one level deeper, and those larger than CROWD[1] two. A pair at similarity 0.8 shares a prefix of
#: 5, 6 or 7 values in none of 40 orders with probability 1.2e-7, 5e-6 or 8e-5.
TREES, DEPTH, CROWD = 40, 5, (32, 128)
DEEP = DEPTH + len(CROWD)
#: Distinct sets, and shingles of these, that a block holds; larger candidate components are compared block by block, then by hubs.
BLOCK, BLOCK_SHINGLES = 5_000, 2_000_000
#: Postings that are looked at together when one set is compared with all others.
STEP = 1 << 22
#: A set's number: 24 bits of task, 24 of chunk, 15 of its place in the chunk.
CHUNK_BITS, SET_BITS = 24, 15
ENTRY = np.dtype([("uid", "<i8"), ("tree", "<u2"), ("v", "<u2", (DEEP,))])
CHUNK = "gid bigint, body binary, docs array<struct<doc_id:bigint,n:bigint,uid:bigint,set_id:binary>>, probes array<struct<shard:int,entries:binary>>"


def _multipliers() -> np.ndarray:
    return (mix64(np.arange(1, TREES * DEEP + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest value under each of the hash functions, folded to 16 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(factors), 2**32 - 1, np.uint32)
    for a in range(0, len(x), 128):
        np.minimum(low, (x[a : a + 128, None] * factors).min(axis=0), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def neighbours(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate links (hub, member) of the runs of common prefixes in each tree's sorted order."""
    v = e["v"].astype(np.uint64)
    hi = e["tree"].astype(np.uint64) << np.uint64(48) | v[:, 0] << np.uint64(32) | v[:, 1] << np.uint64(16) | v[:, 2]
    lo = v[:, 3] << np.uint64(48) | v[:, 4] << np.uint64(32) | v[:, 5] << np.uint64(16) | v[:, 6]
    e = e[np.lexsort((lo, hi))]
    hubs, members = [], []

    def runs(rows: np.ndarray, depth: int) -> None:
        new = np.ones(len(rows), bool)
        new[1:] = (rows["tree"][1:] != rows["tree"][:-1]) | (rows["v"][1:, :depth] != rows["v"][:-1, :depth]).any(axis=1)
        size = np.diff(np.append(np.flatnonzero(new), len(rows)))
        at = np.repeat(size, size)
        if depth < DEEP and (deep := at > CROWD[depth - DEPTH]).any():
            runs(rows[deep], depth + 1)
            rows, new, at = rows[~deep], new[~deep], at[~deep]
        rows, new = rows[at > 1], new[at > 1]
        if len(rows):
            first = np.flatnonzero(new)
            hubs.append(np.repeat(np.minimum.reduceat(rows["uid"], first), np.diff(np.append(first, len(rows)))))
            members.append(rows["uid"])

    if len(e):
        runs(e, DEPTH)
    if not hubs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(hubs), np.concatenate(members)
    pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
    return pairs[:, 0], pairs[:, 1]


def spanning(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) for the nodes of these links that aren't roots; a root is the smallest node of its component here."""
    pairs = np.unique(pairs, axis=0)
    nodes, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        low = root.copy()
        near = np.minimum(root[a], root[b])
        np.minimum.at(low, root[a], near)
        np.minimum.at(low, root[b], near)
        while (low[low] != low).any():
            low = low[low]
        low = low[root]
        if (low == root).all():
            break
        root = low
    odd = root != np.arange(len(nodes))
    return nodes[root[odd]], nodes[odd]


def forest(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, weight) of each set under links 100 * common >= percent * union, over all pairs by way of postings; weight: how often its shingles are shared."""
    m, root = len(sets), list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), size)
    every = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    start = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(every)))
    term = np.empty(len(every), np.int64)
    term[order] = np.repeat(np.arange(len(start)), count)
    bound = np.append(0, np.cumsum(size))
    weight = np.add.reduceat(count[term], bound[:-1][size > 0]) if len(every) else np.zeros(0)
    heavy = np.zeros(m)
    heavy[size > 0] = weight
    left = m
    heavy = heavy / np.maximum(size, 1)
    for i in np.argsort(-heavy, kind="stable").tolist():  # the sets that share most come first
        if left == 1:
            break
        t = term[bound[i] : bound[i + 1]]
        n = count[t]
        t, n = t[n > 1], n[n > 1]
        if not len(t):
            continue
        common, ends, k = np.zeros(m, np.int64), np.cumsum(n), 0
        while k < len(t):  # in steps, to bound the arrays when many sets share many terms
            z = max(k + 1, int(np.searchsorted(ends, ends[k] - n[k] + STEP, side="right")))
            some = n[k:z]
            at = np.repeat(start[t[k:z]] - np.append(0, np.cumsum(some)[:-1]), some) + np.arange(some.sum())
            common += np.bincount(owner[at], minlength=m)
            k = z
        for j in np.flatnonzero(100 * common >= percent * np.maximum(size + size[i] - common, 1)).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                left -= 1
    return np.array([find(i) for i in range(m)], np.int64), heavy


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A text's set holds its distinct shingles of `words` words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a shorter
    text is one shingle; null, empty and blank texts have no shingle and no link. Texts are linked when 100 * common
    >= percent * union. Every row is a document of its own, also where rows share an id: an id is no link, and one id can
    be in two components. component_id is the smallest id of the rows reachable, and kept marks one row of each component:
    that with the smallest id and, of rows that share it, the one with the smaller set, then by a digest of the set, then
    by its place. Where ids are unique, kept is doc_id = component_id. A null id sorts below all others and is returned as
    null. An empty table gives no rows; further columns, whatever their names, are ignored.

    Tasks pack documents into chunks and send each distinct set's signature to shards, one entry for each of the
    forest's trees; a shard sorts its entries and links neighbours with a long enough common prefix. Components of these
    candidate links name the sets to compare; equal sets are compared once, and each task confirms links over full sets
    by postings, so that no pair is written out. A component too large for a task is compared within blocks first, then the
    hubs of the blocks' classes with each other, and last only the sets outside its largest class with all of it: a group of
    near copies of any size takes time in proportion.
    """
    return _classes(docs.select(id_col, text_col), id_col, text_col, words, percent)[1].select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows that near_dedup keeps, whole and with all their columns: one of each component, whatever their ids.

    Rows are told apart by their place in the written chunks, so null and repeated ids neither lose a text nor keep two.
    """
    chunks, told = _classes(docs, id_col, text_col, words, percent)
    stay = told.where("kept").groupBy("gid").agg(F.collect_list("pos").alias("places"))  # of one chunk, 2^15 at most

    def take(batches):
        for b in batches:
            for body, places in zip(b.column("body").to_pylist(), b.column("places").to_pylist(), strict=True):
                yield unpack(body).take(pa.array(sorted(places), pa.int64()))

    return chunks.select("gid", "body").join(stay.hint("merge"), "gid").select("body", "places").mapInArrow(take, docs.schema)


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The written chunks of whole rows, and for each row its place (gid, pos) there, its class and whether it stays."""
    spark = docs.sparkSession
    work, n_shards = Work(spark, "near"), shards_for(docs)

    def send(batches):
        factors, gid = _multipliers(), group_seed() >> (32 - CHUNK_BITS)
        entry = pa.list_(pa.struct([("shard", pa.int32()), ("entries", pa.binary())]))
        doc = pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("uid", pa.int64()), ("set_id", pa.binary())]))
        for b in pieces(batches, text_col, 2 << 20, 1 << SET_BITS):
            sets = shingle_sets(*texts_of(b, text_col), words)
            seen, rows, signatures = {}, [], []
            for i, s in zip(ids_of(b, id_col).tolist(), sets, strict=True):
                key = xxhash.xxh3_128_digest(s.tobytes())
                if key not in seen:
                    seen[key] = (gid << SET_BITS) + len(seen)
                    if len(s):
                        signatures.append((seen[key], signature(s, factors)))
                rows.append({"doc_id": i, "n": len(s), "uid": seen[key], "set_id": key})
            e = np.zeros((len(signatures), TREES), ENTRY)
            if signatures:
                e["uid"] = np.array([u for u, _ in signatures])[:, None]
                e["tree"] = np.arange(TREES)
                e["v"] = np.stack([s for _, s in signatures]).reshape(-1, TREES, DEEP)
            e = e.reshape(-1)
            h = e["tree"].astype(np.uint64)
            for k in range(DEPTH):
                h = h * np.uint64(65599) + e["v"][:, k]
            shard = (mix64(h) % np.uint64(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            e, shard = e[order], shard[order]
            cut = np.flatnonzero(np.diff(shard)) + 1
            probes = [{"shard": int(shard[a]), "entries": e[a:z].tobytes()} for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(e)], strict=True)] if len(e) else []
            yield pa.RecordBatch.from_arrays([pa.array([gid]), pa.array([pack(b)], pa.binary()), pa.array([rows], doc), pa.array([probes], entry)], names=["gid", "body", "docs", "probes"])
            gid += 1

    chunks = work.save(docs.mapInArrow(send, CHUNK), "chunks", packed=True)

    def sort(key, t):
        a, b = neighbours(np.frombuffer(b"".join(t["entries"].to_pylist()), ENTRY))
        part = (mix64(b.astype(np.uint64)) % np.uint64(n_shards)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, pairs = part[order], np.stack([a, b], 1)[order]
        cut = np.flatnonzero(np.diff(part)) + 1
        cuts = list(zip([0, *cut.tolist()], [*cut.tolist(), len(part)], strict=True)) if len(part) else []
        return pa.table({"part": pa.array([int(part[i]) for i, _ in cuts], pa.int32()), "pairs": pa.array([pairs[i:j].tobytes() for i, j in cuts], pa.binary())})

    def contract(key, t):
        a, b = spanning(np.frombuffer(b"".join(t["pairs"].to_pylist()), np.int64).reshape(-1, 2))
        return pa.table({"a": a, "b": b})

    # A document of a large group has another hub in each tree; a part's spanning forest keeps one link for it.
    part = chunks.select(F.inline("probes")).groupBy("shard").applyInArrow(sort, "part int, pairs binary")
    links = work.save(part.groupBy("part").applyInArrow(contract, "a bigint, b bigint"), "links")
    near = components(links, work).select(F.col("node").alias("uid"), F.col("label").alias("comp"))
    rows = chunks.select("gid", F.posexplode("docs").alias("pos", "d")).select("gid", "pos", "d.*")
    # Of equal sets one is compared; components with one distinct set are done.
    sets = rows.where("n > 0").select("uid", "set_id", "n").join(near, "uid").groupBy("comp", "set_id").agg(F.min("uid").alias("uid"), F.min("n").alias("n"))
    sets = work.save(sets, "sets")
    sized = sets.groupBy("comp").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    todo = work.save(sets.join(sized.select("comp"), "comp").select("comp", "uid", "n"), "todo")

    def fetch(batches):
        for b in batches:
            for body, docs_, want in zip(b.column("body").to_pylist(), b.column("docs").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                place = {}
                for k, d in enumerate(docs_):
                    place.setdefault(d["uid"], k)
                picked = sorted({place[w["uid"]] for w in want})
                rows_ = unpack(body).take(pa.array(picked, pa.int64()))
                found = dict(zip(picked, shingle_sets(*texts_of(rows_, text_col), words), strict=True))
                for k in range(0, len(want), 1000):
                    part = want[k : k + 1000]
                    cols = {c: [w[c] for w in part] for c in ("task", "comp", "i", "j", "uid")}
                    yield pa.RecordBatch.from_pydict(cols | {"s": pa.array([found[place[w["uid"]]].tobytes() for w in part], pa.binary())}, pa.schema([("task", pa.int32()), ("comp", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("uid", pa.int64()), ("s", pa.binary())]))

    def confirm(key, t):
        order = pa.compute.sort_indices(t, [("comp", "ascending"), ("i", "ascending"), ("j", "ascending"), ("uid", "ascending")])
        t = t.take(order)
        comp, i, j, uid = (t[c].to_numpy() for c in ("comp", "i", "j", "uid"))
        cut = np.flatnonzero((comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        bodies, a_, b_, hub = t["s"].to_pylist(), [], [], []
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(comp)], strict=True):
            u = uid[a:z]
            r, weight = forest([np.frombuffer(x, np.uint64) for x in bodies[a:z]], percent)
            order = np.lexsort((np.arange(len(r)), -weight, r))
            first = np.append(True, r[order][1:] != r[order][:-1])
            best = np.zeros(len(r), np.int64)
            best[r[order][first]] = order[first]
            a_.append(u[r])
            b_.append(u)
            hub.append(u[best[r]])
        return pa.table({"comp": comp, "a": np.concatenate(a_), "b": np.concatenate(b_), "hub": np.concatenate(hub)})

    def compare(parts: DataFrame, name: str) -> DataFrame:
        """parts(comp, uid, i, j): the sets of each (comp, i, j) are compared in one task: (comp, a, b, hub), the root of each set there, and the set of its class that shares most."""
        n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts.count() // 4000)
        wanted = parts.select(F.shiftright("uid", SET_BITS).alias("gid"), "uid", "comp", "i", "j", F.pmod(F.xxhash64("comp", "i", "j"), F.lit(n_tasks)).cast("int").alias("task"))
        wanted = wanted.groupBy("gid").agg(F.collect_list(F.struct("uid", "comp", "i", "j", "task")).alias("wanted"))
        sent = chunks.select("gid", "body", "docs").join(wanted.hint("merge"), "gid").select("body", "docs", "wanted").mapInArrow(fetch, "task int, comp bigint, i int, j int, uid bigint, s binary")
        return work.save(sent.groupBy("task").applyInArrow(confirm, "comp bigint, a bigint, b bigint, hub bigint"), name)

    def dealt(rows: DataFrame) -> DataFrame:
        """rows(comp, uid, n) with the number of blocks of their component, and their own."""
        many = rows.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        return rows.join(many, "comp").withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))

    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    links = lambda *found: reduce(DataFrame.unionByName, [r.where("a != b").select("a", "b") for r in found])
    todo = work.save(dealt(todo), "dealt")
    roots = compare(todo.select("comp", "uid", F.col("own").alias("i"), F.col("own").alias("j")), "roots")
    large = todo.where("blocks > 1")
    if large.isEmpty():  # each component was whole in its task
        label = roots.where("a != b").select(F.col("b").alias("uid"), F.col("a").alias("label"))
    else:
        # Classes of different blocks are compared by their hubs; near copies are mostly one class then.
        hubs = roots.join(large.select("comp").distinct(), "comp", "left_semi").select("comp", F.col("hub").alias("uid")).distinct()
        every = dealt(hubs.join(todo.select("uid", "n"), "uid").select("comp", "uid", "n")).select("comp", "uid", "own", upto("blocks").alias("other"))
        met = compare(every.select("comp", "uid", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")), "roots_of_hubs")
        known = components(links(roots, met), work, "cc2").select(F.col("node").alias("uid"), F.col("label").alias("class"))
        classed = work.save(large.join(known, "uid", "left").select("comp", "uid", "n", "blocks", "own", F.coalesce("class", "uid").alias("class")), "classed")
        per = classed.groupBy("comp", "class").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
        most = per.groupBy("comp").agg(F.max(F.struct("k", "class")).alias("top"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
        # What is outside of a component's largest class meets all of it; pairs within that class are known already.
        rest = work.save(classed.join(most.select("comp", F.col("top.class").alias("top")), "comp"), "rest")
        found = [roots, met]
        if not rest.isEmpty():
            side = dealt(rest.where("class != top").select("comp", "uid", "n"))
            n_side = side.select("comp", F.col("blocks").alias("side")).distinct()
            a = rest.join(n_side, "comp").select("comp", "uid", upto("side").alias("i"), F.col("own").alias("j"))
            b = side.select("comp", "uid", F.col("own").alias("i")).join(rest.select("uid", "blocks"), "uid").select("comp", "uid", "i", upto("blocks").alias("j"))
            found.append(compare(a.unionByName(b).distinct(), "roots_of_rest"))
        label = components(links(*found), work, "cc3").select(F.col("node").alias("uid"), "label")
    # Any set's class is that of its label's set; sets that nothing was linked with are classes of their own.
    ids = sets.select("uid", "set_id")
    named = label.join(ids, "uid").select("set_id", "label").join(ids.select(F.col("uid").alias("label"), F.col("set_id").alias("class")), "label").select("set_id", "class")
    named = work.save(named, "named")
    key = F.struct("doc_id", "n", "set_id", "gid", "pos")
    every = rows.where("n > 0").join(named, "set_id", "left").select("gid", "pos", "doc_id", "n", key.alias("key"), F.coalesce("class", "set_id").alias("class"))
    every = work.save(every, "every")
    least = work.save(every.groupBy("class").agg(F.min("key").alias("least")), "least")  # as a table: a hot class's join can be split
    linked = every.join(least, "class").select("gid", "pos", "doc_id", "n", F.col("least.doc_id").alias("least"), (F.col("key") == F.col("least")).alias("kept"))
    done = linked.unionByName(rows.where("n = 0").select("gid", "pos", "doc_id", "n", F.col("doc_id").alias("least"), F.lit(True).alias("kept")))
    known = F.nullif(F.col("doc_id"), F.lit(NULL_ID)), F.nullif(F.col("least"), F.lit(NULL_ID))
    return chunks, done.select("gid", "pos", known[0].alias("doc_id"), F.col("n").alias("n_shingles"), known[1].alias("component_id"), "kept")
