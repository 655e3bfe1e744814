"""What the operators share: work tables in the cluster's shared folder, Arrow batches, chunk packing."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the kernels; it sorts before every other id.
NULL_ID = -(2**63)
#: Bytes of the ASCII white space class [\x20\x09-\x0D].
WS = b" \t\n\x0b\x0c\r"
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches by bytes, so that very long texts don't pile up in a Python worker."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings for a while; underscores stand for dots."""
    old = {k: spark.conf.get(k, None) for k in (name.replace("__", ".") for name in conf)}
    try:
        for name, v in conf.items():
            spark.conf.set(name.replace("__", "."), v)
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may fall back on a folder of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="memspark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def delete(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Deletes a folder, now or when the application ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if at_exit:
        fs.deleteOnExit(p)
    else:
        fs.delete(p, True)


_UNDER: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession, root: str):
    """Work tables of operators that are called within go under root and are deleted at the end: results must be written by then."""
    _UNDER.append(root)
    try:
        yield
    finally:
        _UNDER.remove(root)
        delete(spark, root)


class Work:
    """Work tables of one run of an operator, under the shared folder. They go when the application ends, or earlier by drop() or scratch()."""

    def __init__(self, spark: SparkSession, name: str):
        tune(spark)
        self.spark, self.root = spark, f"{_UNDER[-1] if _UNDER else shared_dir(spark)}/memspark_{name}_{uuid.uuid4().hex[:12]}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str, packed: bool = False) -> DataFrame:
        """Writes and rereads df: lineage ends here, and a lost executor costs no more than its own tasks. packed: compressed already."""
        writer = df.write.mode("overwrite").option("compression", "uncompressed" if packed else "zstd")
        # Rows may be chunks of megabytes: their size is looked at from the fourth on, not from the hundredth.
        writer.option("parquet.block.size", 32 << 20).option("parquet.block.size.row.check.min", 4).parquet(self.path(table))
        delete(self.spark, self.root, at_exit=True)
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            delete(self.spark, self.path(t))


#: Plan nodes under which a file's size still tells how much there is to read.
PLAIN = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "LocalRelation"}


def input_bytes(df: DataFrame) -> int:
    """Size of the input: the files' sizes where the frame is a scan of files, else text and binary columns measured in a pass."""
    node, names = df._jdf.queryExecution().optimizedPlan(), set()
    while True:
        names.add(str(node.nodeName()).split(" ")[0])
        if node.children().size() != 1:
            break
        node = node.children().head()
    if names <= PLAIN | {"Relation"} and not node.children().size():
        n = int(str(node.stats().sizeInBytes()))
        if n < 1 << 60:
            return n
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    each = sum(wide, F.lit(8)).cast("long")
    return df.agg(F.sum(each)).first()[0] or 0


def shards_for(df: DataFrame, per_shard: int = 32 << 20) -> int:
    """Shards that grow with the input: at least the session's shuffle partitions, and one for each per_shard input bytes."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(input_bytes(df) / per_shard), 1)


def clean_columns(df: DataFrame, *made: str) -> DataFrame:
    """Without columns that bear the name of a result column."""
    low = {m.lower() for m in made}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def ids_of(batch: pa.RecordBatch, col: str) -> np.ndarray:
    a = batch.column(batch.schema.get_field_index(col)).cast(pa.int64())
    return a.fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def texts_of(batch: pa.RecordBatch, col: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and n + 1 offsets; nulls are empty."""
    a = batch.column(batch.schema.get_field_index(col)).cast(pa.large_string()).fill_null("")
    n, buf = len(a), a.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(buf[1], np.int64, n + 1, a.offset * 8)
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pack(batch: pa.RecordBatch) -> bytes:
    """A batch of whole rows as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(body: bytes) -> pa.RecordBatch:
    t = pa.ipc.open_stream(body).read_all().combine_chunks()
    return t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_pylist([], t.schema)


def pieces(batches: Iterator[pa.RecordBatch], col: str, most: int = 4 << 20, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Batches cut or left so that each holds about `most` bytes of text and `rows` rows at most, and one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = texts_of(b, col)
        at = 0
        while at < b.num_rows:
            end = min(at + rows, max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1))
            yield b.slice(at, end - at)
            at = end


def put(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns added, or replaced by name."""
    arrays = dict(zip(batch.schema.names, batch.columns, strict=True)) | columns
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def group_seed() -> int:
    """A number for each task, from which chunk ids are counted: task << 32."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return (ctx.partitionId() if ctx else 0) << 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
