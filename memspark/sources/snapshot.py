"""Versioned snapshots of all tables, published by one manifest."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import KEYS, SCHEMA_VERSION, TABLES


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master one of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="memspark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def settle(spark: SparkSession) -> SparkSession:
    """The session, without unions that keep their parts' partitioning: adaptive plans may join partitions of one part and not of the other, and then fail."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of a path, as the JVM's objects."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def new_folder(spark: SparkSession, name: str = "memspark") -> str:
    """A new folder's path in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex[:12]}"
    fs, p = _file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def write(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path; it goes when the application ends."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)  # hex digests take half
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage ends and a lost executor costs nothing."""
    return write(df)[0]


class Tables(Mapping):
    """Tables by name, some given as what makes them: that runs when the table is first asked for."""

    def __init__(self, made: Mapping[str, DataFrame | Callable[[], DataFrame]] = {}):  # noqa: B006
        self._made = dict(made)

    def __getitem__(self, name: str) -> DataFrame:
        if callable(self._made[name]):
            self._made[name] = self._made[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._made)

    def __len__(self) -> int:
        return len(self._made)

    def __or__(self, other: Mapping) -> Tables:
        return Tables(self._made | (other._made if isinstance(other, Tables) else dict(other)))

    def __ror__(self, other: Mapping) -> Tables:
        return Tables(dict(other) | self._made)


class Snapshots:
    """Snapshots under a root in any Hadoop file system. A reader sees all tables of one version or none of it.

    A version is a manifest, a file that is created once and never changed, over folders that are written once; the
    current version is the last whole manifest. A commit that finds its number taken has lost against another. That is
    one step on HDFS and POSIX file systems, whose create refuses a file that is there; on an object store only where it
    has conditional writes (as s3a with fs.s3a.create.conditional.enabled), else two writers need a lock of their own.

    Tables with keys (schemas.KEYS) lie in buckets by a hash of their bucket columns. A listing tells for each bucket its
    folder, rows, and smallest and largest key; a change rewrites only the buckets that it touches, and takes the others
    over from the version before. The listing is a file of its own, so a commit writes those of the changed tables only.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = settle(spark), root.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._io = jvm.org.apache.commons.io.IOUtils

    def _read(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> None:
        """Creates a file; refuses if there is one of that name."""
        p = self._path(f"{self.root}/{name}")
        if self._fs.exists(p):
            raise RuntimeError(f"{p} is there already: another commit came between")
        stream = self._fs.create(p, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """Numbers of all manifests, whole or not, the last first."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [str(f.getPath().getName()) for f in self._fs.listStatus(folder)]
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def _manifest(self, version: int) -> dict | None:
        """A whole manifest, or None for one that is missing or was not written to its end."""
        try:
            return json.loads(self._read(f"manifests/{version:08d}.json") or "")
        except ValueError:
            return None

    def version(self) -> int:
        """The current version; 0 before the first commit."""
        return next((v for v in self.versions() if self._manifest(v) is not None), 0)

    def manifest(self, version: int | None = None) -> dict:
        found = self._manifest(version or self.version())
        if found is None:
            raise FileNotFoundError(f"no snapshot {version or self.version()} under {self.root}")
        return found

    def listing(self, table: str, version: int | None = None) -> dict | None:
        """Buckets of a table: {"n": number, "buckets": {number: {path, rows, low, high}}}; None for one that has none."""
        v = version or self.version()
        entry = self.manifest(v)["tables"].get(table) if v else None
        return json.loads(self._read(entry["path"])) if entry and entry.get("bucketed") else None

    def _bucket(self, table: str, n: int, schema=None) -> Column:
        """A row's bucket: by the bucket columns in the types of the table."""
        kinds = {f.name: f.dataType for f in schema or self.spark.createDataFrame([], TABLES[table]).schema}
        return F.pmod(F.xxhash64(*[F.col(c).cast(kinds[c]) for c in KEYS[table][0]]), F.lit(n)).cast("int")

    def buckets_of(self, table: str, keys: DataFrame, version: int | None = None) -> list[int]:
        """The buckets of these keys (rows with the table's bucket columns): as many as the table has, at most."""
        found = self.listing(table, version)
        n = found["n"] if found else self.buckets
        return sorted(r[0] for r in keys.select(self._bucket(table, n)).distinct().collect())

    def read(self, table: str, version: int | None = None, buckets: list[int] | None = None, between: tuple | None = None) -> DataFrame:
        """A table, or some of its buckets; what a snapshot lacks is empty with its schema. Other schema versions are refused.

        between=(low, high) leaves out the buckets, and the rows, whose first key column is not in the range.
        """
        v = version or self.version()
        m = self.manifest(v) if v else {"schema_version": SCHEMA_VERSION, "tables": {}}
        if m["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"snapshot {v} has schema version {m['schema_version']}, not {SCHEMA_VERSION}")
        if table not in m["tables"]:
            return self.spark.createDataFrame([], TABLES[table])
        entry = m["tables"][table]
        reader, first = self.spark.read.schema(entry["schema"]), KEYS[table][1][0] if table in KEYS else None
        in_range = F.lit(True) if between is None else F.col(first).between(*between)
        if not entry.get("bucketed"):
            return reader.parquet(f"{self.root}/{entry['path']}").where(in_range)
        found = json.loads(self._read(entry["path"]))["buckets"]
        wanted = [x for b, x in found.items() if buckets is None or int(b) in buckets]
        wanted = [x for x in wanted if between is None or x["low"] is None or not (x["high"] < str(between[0]) or x["low"] > str(between[1]))]
        if not wanted:
            return self.spark.createDataFrame([], entry["schema"])
        return reader.parquet(*[f"{self.root}/{x['path']}" for x in wanted]).where(in_range)

    def store(self, version: int | None = None) -> dict[str, DataFrame]:
        return {t: self.read(t, version) for t in TABLES}

    def _write(self, name: str, df: DataFrame, commit_id: str, old: dict | None, only: list[int] | None, placed: bool = False) -> dict:
        """The manifest's entry of a table whose buckets (all, or those in `only`) are now the rows of df; placed: each task has the rows of few buckets."""
        schema = df._jdf.schema().toDDL()
        if name not in KEYS or not set(KEYS[name][0] + KEYS[name][1]) <= set(df.columns):
            df.write.option("compression", "zstd").parquet(f"{self.root}/tables/{commit_id}/{name}")
            return {"path": f"tables/{commit_id}/{name}", "schema": schema}
        n, path, key = old["n"] if old else self.buckets, f"tables/{commit_id}/{name}", KEYS[name][1][0]
        dealt = df.withColumn("_bucket", self._bucket(name, n, df.schema))
        if not placed:  # Rebalancing splits a bucket that is too large for a task, and joins small ones.
            dealt = dealt.hint("rebalance", "_bucket")
        dealt.write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.root}/{path}")
        back = self.spark.read.schema(f"{schema}, _bucket int").parquet(f"{self.root}/{path}")
        told = back.groupBy("_bucket").agg(F.count(F.lit(1)).alias("rows"), F.min(key).cast("string").alias("low"), F.max(key).cast("string").alias("high")).collect()  # n rows at most
        new = {str(r["_bucket"]): {"path": f"{path}/_bucket={r['_bucket']}", "rows": r["rows"], "low": r["low"], "high": r["high"]} for r in told}
        if only is not None:
            if not set(map(int, new)) <= set(only):
                raise ValueError(f"rows of {name} belong to other buckets than the given")
            new = {b: x for b, x in (old or {"buckets": {}})["buckets"].items() if int(b) not in only} | new
        self._create(f"{path}.json", json.dumps({"n": n, "buckets": new}))
        return {"path": f"{path}.json", "schema": schema, "bucketed": True}

    def commit(self, tables: dict[str, DataFrame], note: str = "", expected: int | None = None, buckets: dict[str, list[int]] | None = None, deal: int | None = None, placed: tuple[str, ...] = ()) -> int:
        """Writes the given tables, takes over the others, and creates the next manifest. Refuses if another commit came between, or `expected` isn't the current version.

        buckets: for tables named here the frame holds all rows of just these buckets, and the others stay as they are.
        deal: a new number of buckets for whole tables. placed: tables whose rows are still as they were read from their
        buckets; they are written by the tasks that read them, without a shuffle.
        """
        now = self.version()
        if expected is not None and expected != now:
            raise RuntimeError(f"the snapshot is at version {now}, not {expected}")
        kept = dict(self.manifest(now)["tables"]) if now else {}
        commit_id = uuid.uuid4().hex
        for name, df in tables.items():
            only = (buckets or {}).get(name)
            old = self.listing(name, now) if now else None
            if old is None and only is not None and name in kept:
                raise ValueError(f"{name} has no buckets yet")
            if deal is not None and only is None:
                old = {"n": deal, "buckets": {}}
            kept[name] = self._write(name, df, commit_id, old, only, name in placed)
        return self._publish(now, commit_id, note, kept)

    def one_each(self, name: str, df: DataFrame) -> DataFrame:
        """df as a table with one row for each key; of several rows with a key the same one in every run. Only keys that come twice are shuffled with their rows."""
        keys = KEYS[name][1]
        rows, key = cut(df), F.xxhash64(*keys).alias("_key")
        twice = rows.groupBy(key).count().where("count > 1").select("_key")
        if twice.isEmpty():
            return rows
        flat = [f.name for f in df.schema if not f.dataType.simpleString().startswith("map")]
        keyed, twice = rows.withColumn("_key", key), cut(twice)
        w = Window.partitionBy(*keys).orderBy(F.xxhash64(*flat))
        first = keyed.join(twice, "_key", "left_semi").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        return cut(keyed.join(twice, "_key", "left_anti").unionByName(first).drop("_key"))

    def change(self, upserts: dict[str, DataFrame] | None = None, deletes: dict[str, DataFrame] | None = None, replaces: dict[str, tuple[DataFrame, DataFrame]] | None = None, note: str = "", expected: int | None = None, settled: tuple[str, ...] = (), whole: dict[str, tuple[DataFrame, list[int]]] | None = None, placed: tuple[str, ...] = ()) -> int:
        """One commit of changed rows; only the buckets they lie in are read and written.

        deletes: frames of (some) key columns; rows that match go. replaces: (scope, rows): the rows whose values are in
        scope go, and the given ones come. upserts: rows that take the place of those with their key; of several rows with a
        key one counts, the same in every run. They are applied in this order. Where a frame lacks the bucket columns, the
        buckets are those in which its rows are found. settled: tables whose upserts are written already, with one row a
        key (one_each). whole: (rows, buckets) of tables whose buckets are given as a whole. placed: as in commit.
        """
        upserts, deletes, replaces = upserts or {}, deletes or {}, replaces or {}
        now, out, touched = self.version(), {}, {}
        for name in {**deletes, **replaces, **upserts}:
            (by, keys), kind = KEYS[name], self.read(name, now)
            like = lambda df: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.schema])  # noqa: E731, B023
            gone = [df for df in (deletes.get(name), replaces.get(name, (None,))[0]) if df is not None]
            come = [like(df) for df in (replaces.get(name, (None, None))[1],) if df is not None]
            if name in upserts:
                one = like(upserts[name]) if name in settled else self.one_each(name, like(upserts[name]))
                gone.append(one.select(*keys))
                come.append(one)
            hit: set[int] = set()
            for df in (*gone, *come):
                if set(by) <= set(df.columns):
                    hit |= set(self.buckets_of(name, df, now))
                else:
                    found = kind.join(df.distinct(), df.columns, "left_semi")
                    hit |= set(self.buckets_of(name, found, now))
            held, rows = self.listing(name, now), self.read(name, now, sorted(hit))
            bare = (held is None and not (now and name in self.manifest(now)["tables"])) or (held is not None and not hit & set(map(int, held["buckets"])))
            for df in () if bare else gone:  # no rows lie there yet
                rows = rows.join(df.distinct(), df.columns, "left_anti").select(*kind.columns)
            for df in come:
                rows = rows.unionByName(df)
            out[name], touched[name] = rows, sorted(hit)
        for name, (rows, hit) in (whole or {}).items():
            out[name], touched[name] = rows, hit
        return self.commit(out, note, now if expected is None else expected, placed=placed, buckets={t: b for t, b in touched.items() if self.listing(t, now) or t not in (self.manifest(now)["tables"] if now else {})})

    def put(self, name: str, listing: dict, uses: list[str], commit_id: str, base: int, note: str = "", tables: dict | None = None) -> int:
        """Publishes a listing of its own kind (a log, an index) over folders in `uses`, with changed entries of tables."""
        path = f"tables/{commit_id}/{name}.json"
        self._create(path, json.dumps(listing))
        kept = dict(self.manifest(base)["tables"]) if base else {}
        return self._publish(base, commit_id, note, kept | (tables or {}) | {name: {"path": path, "uses": uses}})

    def get(self, name: str, version: int | None = None) -> dict | None:
        """A listing that put() has published."""
        v = version or self.version()
        entry = self.manifest(v)["tables"].get(name) if v else None
        return json.loads(self._read(entry["path"])) if entry else None

    def _publish(self, base: int, commit_id: str, note: str, tables: dict) -> int:
        if self.version() != base:
            raise RuntimeError(f"the snapshot is at version {self.version()}, not {base}: another commit came between")
        # Numbers of manifests that were never finished are passed over.
        v = 1 + next(iter(self.versions()), 0)
        self._create(f"manifests/{v:08d}.json", json.dumps({"version": v, "commit_id": commit_id, "schema_version": SCHEMA_VERSION, "note": note, "tables": tables}))
        return v

    def rollback(self, version: int) -> int:
        """A new version with the tables of an older one, which must be whole. No version is ever changed."""
        return self._publish(self.version(), uuid.uuid4().hex, f"rollback to {version}", self.manifest(version)["tables"])

    def compact(self, table: str, n: int) -> int:
        """Rewrites a table as so many buckets, or files if it has no key."""
        if table in KEYS:
            return self.commit({table: self.read(table)}, f"compact {table}", deal=n)
        return self.commit({table: self.read(table).repartition(n)}, f"compact {table}")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the folders that none of the last `keep` whole versions reads, and returns how many. Older versions can't be read after."""
        whole = [m for v in self.versions() if (m := self._manifest(v)) is not None][:keep]
        used = set()
        for m in whole:
            for entry in m["tables"].values():
                used |= {entry["path"], *entry.get("uses", [])}
                if entry.get("bucketed"):
                    used |= {x["path"] for x in json.loads(self._read(entry["path"]))["buckets"].values()}
        gone, start = 0, len(str(self._fs.makeQualified(self._path(self.root)))) + 1
        for commit in self._list("tables"):
            for item in self._list(commit[start:]):
                rel = item[start:]
                if rel in used:
                    continue
                inner = [x for x in self._list(rel) if "/_bucket=" in x]
                unused = [x for x in inner if x[start:] not in used] if inner else [item]
                for x in unused if len(unused) < len(inner) else [item]:
                    self._fs.delete(self._path(x), True)
                    gone += 1
        return gone

    def _list(self, name: str) -> list[str]:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p) or not self._fs.getFileStatus(p).isDirectory():
            return []
        return sorted(str(self._fs.makeQualified(f.getPath())) for f in self._fs.listStatus(p))


def verify(store: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table and bridge rows without their ends."""
    def missing(bridge: str, key: str, table: str) -> DataFrame:
        lost = store[bridge].join(store[table].select(F.col("hash").alias(key)), key, "left_anti")
        return lost.agg(F.lit(f"{bridge}.{key}").alias("name"), F.count(F.lit(1)).alias("dangling"))

    out = missing("paragraph_entity", "paragraph_hash", "paragraph")
    for b, k, t in (("paragraph_entity", "entity_hash", "entity"), ("paragraph_relation", "paragraph_hash", "paragraph"), ("paragraph_relation", "relation_hash", "relation")):
        out = out.unionByName(missing(b, k, t))
    return out
