"""A segmented inverted index: immutable segments, live masks, statistics that add up, block maxima."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sparse
from ..operators.blocks import gathered
from .snapshot import Snapshots, cut

#: Postings of a block at most, and of the documents that a task turns into blocks at a time.
BLOCK, ENTRIES = 128, 1 << 20
POSTED = "term string, n int, max_tf int, min_dl int, docs array<bigint>, tfs array<int>, dls array<int>"
BLOCKS = f"{POSTED}, segment int"
#: Blocks of segments whose documents have no numbers.
OLD_BLOCKS = "term string, n int, max_tf int, min_dl int, postings array<struct<hash:string,tf:int,dl:int>>, segment int"
FORWARD = "hash string, dl int, terms array<string>, tfs array<int>, segment int, doc bigint"
#: From so many queries a search passes over all documents in blocks, and does not look for what it can leave out.
MANY = 64
DF = "term string, df bigint"
DEAD = "segment int, hash string, dl int, doc bigint"


def weight(tf: Column, dl: Column, idf: Column, mean: float, k1: float, b: float) -> Column:
    """BM25 of a term in a document; it grows with tf and falls with dl."""
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(mean)))


def post(rows: DataFrame, block: int, entries: int) -> DataFrame:
    """Blocks of forward rows (doc, dl, terms, tfs), made where these lie: of each term the postings of some documents."""

    def posted(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        doc, dl, terms, tfs = (t.column(i).chunk(0) for i in range(4))
        n = np.diff(np.asarray(terms.offsets))
        told = terms.flatten().dictionary_encode()
        code = told.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        doc, dl, tf = np.repeat(np.asarray(doc), n)[order], np.repeat(np.asarray(dl), n)[order], np.asarray(tfs.flatten())[order]
        count = np.bincount(code, minlength=len(told.dictionary))
        parts = -(-count // block)
        place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(np.cumsum(count) - count, parts) + place * block
        off = np.append(start, len(order))
        lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x, kind)) for x, kind in ((doc, pa.int64()), (tf, pa.int32()), (dl, pa.int32()))]
        names = told.dictionary.take(pa.array(np.repeat(np.arange(len(count)), parts)))
        most, least = np.maximum.reduceat(tf, start), np.minimum.reduceat(dl, start)
        return pa.RecordBatch.from_arrays([names, *[pa.array(x, pa.int32()) for x in (np.diff(off), most, least)], *lists], names=["term", "n", "max_tf", "min_dl", "docs", "tfs", "dls"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            ends = np.cumsum([len(x) for x in b.column(2)])
            at = 0
            while at < b.num_rows:
                before = int(ends[at - 1]) if at else 0
                take = int(np.searchsorted(ends, before + entries - size)) + 1 - at
                held.append(b.slice(at, take))
                size, at = size + int(ends[min(at + take, b.num_rows) - 1]) - before, at + take
                if size >= entries:
                    yield posted(pa.Table.from_batches(held))
                    held, size = [], 0
        if size:
            yield posted(pa.Table.from_batches(held))

    return rows.select("doc", "dl", "terms", "tfs").mapInArrow(run, POSTED)


class TextIndex:
    """Postings of docs(hash, content) under a snapshot root; a version shows one state of all segments.

    update() adds one segment with the new documents and marks those that they replace, or that are deleted, dead; no
    segment is ever changed. Numbers of documents, lengths and document frequencies of live documents are sums over
    segments less what is dead, whose terms the forward rows tell. Postings lie in buckets by term and in blocks that know
    their largest tf and smallest length; forward rows lie in buckets by hash. compact() merges all into one segment.

    Forward rows number a segment's documents, and postings name these numbers. Tasks write both where they read: texts,
    hashes and postings are not shuffled. Segments of which all is dead are not read.
    """

    def __init__(self, spark: SparkSession, root: str, name: str = "text_index", mode: str = "word", n: int = 2, buckets: int = 16):
        self.s, self.spark, self.name, self.mode, self.n, self.buckets = Snapshots(spark, root), spark, name, mode, n, buckets

    def state(self, version: int | None = None) -> dict:
        return self.s.get(self.name, version) or {"segments": [], "dead": [], "next": 0}

    def _read(self, paths: list[str], ddl: str) -> DataFrame:
        return self.spark.read.schema(ddl).parquet(*[f"{self.s.root}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], ddl)

    def _buckets(self, df: DataFrame, key: str) -> list[int]:
        return sorted(r[0] for r in df.select(F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")).distinct().collect())

    def _parts(self, state: dict, kind: str, ddl: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of all segments, or of some of their buckets."""
        return self._read([f"{x['path']}/{kind}/_bucket={b}" for x in state["segments"] for b in x[kind] if buckets is None or b in buckets], ddl)

    def _save(self, df: DataFrame, path: str, key: str) -> list[int]:
        """Writes rows into their buckets, by the tasks that have them."""
        dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int"))
        dealt.write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.s.root}/{path}")
        return self._held(path)

    def _held(self, path: str) -> list[int]:
        return sorted(int(x.rsplit("=", 1)[1]) for x in self.s._list(path) if "/_bucket=" in x)

    def _segment(self, forward: DataFrame, number: int, path: str) -> dict:
        """Writes forward(hash, dl, terms, tfs) and its postings as a segment."""
        numbered = forward.withColumns({"segment": F.lit(number), "doc": F.monotonically_increasing_id()})
        held = {"path": path, "number": number, "forward": self._save(numbered, f"{path}/forward", "hash")}
        rows = self._parts({"segments": [held]}, "forward", FORWARD)
        held["blocks"] = self._save(post(rows, BLOCK, ENTRIES).withColumn("segment", F.lit(number)), f"{path}/blocks", "term")
        df = self._parts({"segments": [held]}, "blocks", BLOCKS).groupBy("term").agg(F.sum("n").alias("df"))
        df.write.option("compression", "zstd").parquet(f"{self.s.root}/{path}/df")
        docs = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return held | {"docs": docs[0], "length": docs[1], "counted": True, "numbered": True}

    def _counted(self, state: dict) -> bool:
        """Whether all forward rows have counts; segments of older indexes don't."""
        return all(x.get("counted") for x in state["segments"])

    def update(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """docs(hash, content) that are new or changed, and hashes that go. A hash in both is there after."""
        now, state, commit_id = self.s.version(), self.state(), uuid.uuid4().hex
        path, number = f"tables/{commit_id}/{self.name}", state["next"]
        frames = [df.select("hash") for df in (upserts, deletes) if df is not None]
        names = cut(frames[0].unionByName(frames[1]).distinct() if len(frames) > 1 else frames[0].distinct())
        live = self._live(state, "forward", FORWARD, self._buckets(names, "hash"))
        new = {"segments": list(state["segments"]), "dead": list(state["dead"]), "next": number + 1}
        live.select("segment", "hash", "dl", "doc").join(names, "hash", "left_semi").write.option("compression", "zstd").parquet(f"{self.s.root}/{path}/dead")
        told = self._read([f"{path}/dead"], DEAD).groupBy("segment").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).collect()  # a row a segment
        if told:
            gone = live.select("hash", "terms").join(names, "hash", "left_semi")
            gone.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.option("compression", "zstd").parquet(f"{self.s.root}/{path}/dead_df")
            new["dead"].append({"path": path, "docs": sum(r[1] for r in told), "length": sum(r[2] for r in told), "of": {str(r[0]): r[1] for r in told}})
        if upserts is not None:
            new["segments"].append(self._segment(sparse.forward(self._one_each(upserts), self.mode, self.n), number, path))
        return self._put(new, commit_id, now, "update")

    def _one_each(self, docs: DataFrame) -> DataFrame:
        """docs with one content for each hash, the smallest; only texts whose hash comes twice are shuffled."""
        key = F.xxhash64("hash").alias("_key")
        twice = cut(docs.groupBy(key).count().where("count > 1").select("_key"))
        if twice.isEmpty():
            return docs.select("hash", "content")
        keyed = docs.select("hash", "content", key)
        few = keyed.join(twice, "_key", "left_semi").groupBy("hash").agg(F.min("content").alias("content"))
        return keyed.join(twice, "_key", "left_anti").select("hash", "content").unionByName(few)

    def _put(self, state: dict, commit_id: str, base: int, note: str) -> int:
        uses = [x["path"] for x in (*state["segments"], *state["dead"])]
        return self.s.put(self.name, state, sorted(set(uses)), commit_id, base, note)

    def compact(self) -> int:
        """One segment of all live documents, without any mask."""
        now, state, commit_id = self.s.version(), self.state(), uuid.uuid4().hex
        path = f"tables/{commit_id}/{self.name}"
        rows = self._live(state, "forward", FORWARD) if self._counted(state) else gathered(self.postings())
        merged = self._segment(rows.select("hash", "dl", "terms", "tfs"), state["next"], path)
        return self._put({"segments": [merged], "dead": [], "next": state["next"] + 1}, commit_id, now, "compact")

    def needs_compaction(self, segments: int = 10, share: float = 0.3) -> bool:
        s = self.state()
        held = sum(x["docs"] for x in s["segments"])
        return len(s["segments"]) > segments or sum(x["docs"] for x in s["dead"]) > share * max(1, held)

    def _live(self, state: dict, kind: str, ddl: str, buckets: list[int] | None = None) -> DataFrame:
        """Live rows; only those of segments of which a part is dead are joined with what is."""
        whole, mixed, gone = [], [], {}
        for x in state["dead"]:
            for n, k in x.get("of", {}).items():
                gone[int(n)] = gone.get(int(n), 0) + k
        told = all("of" in x for x in state["dead"])
        for x in state["segments"]:
            if not told or 0 < gone.get(x["number"], 0) < x["docs"]:
                mixed.append(x)
            elif x["number"] not in gone:
                whole.append(x)
        rows = self._parts({"segments": whole}, kind, ddl, buckets)
        if not mixed:
            return rows
        kept = self._not_dead(state, self._parts({"segments": mixed}, kind, ddl, buckets), "hash")
        return rows.unionByName(kept.select(*rows.columns)) if whole else kept

    def _not_dead(self, state: dict, rows: DataFrame, key: str) -> DataFrame:
        """rows(segment, `key`, ...) of live documents; key: hash or doc."""
        dead = self._read([f"{x['path']}/dead" for x in state["dead"]], DEAD)
        return rows.join(dead.select("segment", key), ["segment", key], "left_anti") if state["dead"] else rows

    def size(self, version: int | None = None) -> tuple[int, int]:
        """(documents, their length) that are live, from the listing alone."""
        s = self.state(version)
        total = lambda c: sum(x[c] for x in s["segments"]) - sum(x[c] for x in s["dead"])
        return total("docs"), total("length")

    def df(self, version: int | None = None) -> DataFrame:
        """(term, df) over live documents."""
        s = self.state(version)
        come = self._read([f"{x['path']}/df" for x in s["segments"]], DF)
        gone = self._read([f"{x['path']}/dead_df" for x in s["dead"]], DF)
        return come.unionByName(gone.select("term", (-F.col("df")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def _flat(self, state: dict, blocks: DataFrame) -> DataFrame:
        """(term, segment, doc, tf, dl, ...) of the live postings in these blocks, with their further columns."""
        more = [c for c in blocks.columns if c not in ("n", "max_tf", "min_dl", "docs", "tfs", "dls")]
        rows = blocks.select(*more, F.inline(F.arrays_zip(F.col("docs").alias("doc"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))))
        return self._not_dead(state, rows, "doc")

    def postings(self, version: int | None = None) -> DataFrame:
        """All live postings, as sparse.postings() of the live documents would be: from the forward rows, which have the hashes."""
        s = self.state(version)
        if self._counted(s):
            zipped = F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))
            return self._live(s, "forward", FORWARD).select("hash", "dl", F.inline(zipped)).select("term", "hash", "tf", "dl")
        return self._not_dead(s, self._parts(s, "blocks", OLD_BLOCKS).select("term", "segment", F.inline("postings")), "hash").select("term", "hash", "tf", "dl")

    def stale(self, docs: DataFrame) -> DataFrame:
        """A10: (hash, change) of documents that are missing in the index, or gone from docs."""
        live = self._live(self.state(), "forward", FORWARD).select("hash").withColumn("_i", F.lit(True))
        both = docs.select("hash").distinct().withColumn("_d", F.lit(True)).join(live, "hash", "full").where("_i is null or _d is null")
        return both.select("hash", F.when(F.col("_i").isNull(), "add").otherwise("delete").alias("change"))

    def search(self, queries: DataFrame, k: int = 80, k1: float = 1.2, b: float = 0.75, keep: sparse.Keep = None, seeds: int = 50) -> DataFrame:
        """(query_id, hash, score, rank): the same rows as sparse.bm25, without scoring every posting of a hot term.

        First only a query's rarest terms are scored, up to about `seeds` * k postings: the k-th best of these partial sums
        is a floor for its result. Terms whose largest possible weights together stay below the floor can't lift a document
        into it alone, and neither can a block whose maximum, with all other terms at theirs, does. What is left are
        candidates; the skipped terms are then looked up for these alone. keep: filters (query_id, hash, ...), as each query may
        see other documents; what is hidden from a query doesn't count for its floor either. MANY queries without keep
        pass over the forward rows in blocks instead: they need nearly all postings, and partial sums would be shuffled.
        """
        state, (total, length) = self.state(), self.size()
        if not total or not state["segments"]:
            return self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, hash string, score double, rank int")
        mean = length / total
        asked = sparse.query_terms(queries, self.mode, self.n)
        counted, numbered = self._counted(state), all(x.get("numbered") for x in state["segments"])
        if length and (not numbered or keep is None and queries.select("query_id").limit(MANY).count() == MANY):
            rows = self._live(state, "forward", FORWARD).select("hash", "dl", "terms", "tfs") if counted else gathered(self.postings())
            terms = cut(asked)
            df = self.df().join(terms.select("term").distinct(), "term", "left_semi")
            scored = sparse.scored_blocks(rows, terms, df, total, mean, k1, b, None if keep else k)
            return sparse.top(keep(scored) if keep else scored, k)
        known = asked.join(self.df(), "term")
        idf = F.greatest(F.log((F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        asked = cut(known.select("query_id", "term", "df", idf.alias("idf")))
        mine = asked.select("term").distinct()
        blocks = self._parts(state, "blocks", BLOCKS, self._buckets(mine, "term")).join(mine, "term", "left_semi")
        tops = blocks.select("term", "max_tf", "min_dl").join(asked.select("term", "idf").distinct(), "term")
        tops = tops.groupBy("term").agg(F.max(weight(F.col("max_tf"), F.col("min_dl"), F.col("idf"), mean, k1, b)).alias("bound"))
        rare = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
        asked = cut(asked.join(tops, "term").withColumn("seed", F.coalesce(F.sum("df").over(rare), F.lit(0)) < seeds * k))
        names = self._parts(state, "forward", FORWARD).select("segment", "doc", "hash")
        may = (lambda df: keep(df.join(names, ["segment", "doc"])).drop("hash")) if keep else (lambda df: df)
        part = weight(F.col("tf"), F.col("dl"), F.col("idf"), mean, k1, b)

        def flat(terms: DataFrame) -> DataFrame:
            mine = terms.select("term").distinct()
            return self._flat(state, blocks.join(mine, "term", "left_semi")).select("term", "segment", "doc", "tf", "dl")

        seeded = may(flat(asked.where("seed")).join(asked.where("seed"), "term").groupBy("query_id", "segment", "doc").agg(F.sum(part).alias("s")))
        w = Window.partitionBy("query_id").orderBy(F.desc("s"))
        floor = seeded.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == k).select("query_id", (F.col("s") - 1e-8).alias("floor"))
        low = Window.partitionBy("query_id").orderBy("bound", "term")
        whole = Window.partitionBy("query_id")
        plan = asked.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        plan = plan.withColumns({"below": F.sum("bound").over(low), "all": F.sum("bound").over(whole)})
        plan = cut(plan.withColumn("needed", F.col("below") >= F.col("floor")))
        need = plan.where("needed")
        # A query reads a block only if the block can lift a document to its floor.
        room = blocks.join(need.select("query_id", "term", "idf", "floor", "all", "bound"), "term")
        fits = weight(F.col("max_tf"), F.col("min_dl"), F.col("idf"), mean, k1, b) + F.col("all") - F.col("bound") >= F.col("floor")
        hits = self._flat(state, room.where(fits).select("query_id", "term", "idf", "segment", "docs", "tfs", "dls"))
        found = cut(may(hits.groupBy("query_id", "segment", "doc").agg(F.sum(part).alias("s"), F.collect_set("term").alias("seen"))))
        rest = plan.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf", "bound")).alias("terms"), F.first("floor").alias("floor"))
        # Terms of a candidate that were not read: those not needed, and blocks that were passed over.
        left = found.join(rest, "query_id").select("query_id", "segment", "doc", "s", "floor", F.filter("terms", lambda t: ~F.array_contains("seen", t["term"])).alias("more"))
        best = F.col("s") + F.aggregate("more", F.lit(0.0), lambda x, t: x + t["bound"])
        left = left.where(best >= F.col("floor"))
        look = left.select("query_id", "segment", "doc", F.inline("more"))
        extra = look.join(flat(plan), ["term", "segment", "doc"]).groupBy("query_id", "segment", "doc").agg(F.sum(part).alias("x"))
        scored = left.select("query_id", "segment", "doc", "s").join(extra, ["query_id", "segment", "doc"], "left").join(names, ["segment", "doc"])
        return sparse.top(scored.select("query_id", "hash", F.round(F.col("s") + F.coalesce("x", F.lit(0.0)), 9).alias("score")), k)
