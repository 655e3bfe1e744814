"""Chat history from SQLite as a data source."""

import sqlite3

from memspark.sources.chat_source import COLUMNS, ChatHistory, ChatReader, Ids
from memspark.sources.readers import CHAT_HISTORY
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual


def fill(path, ids):
    con = sqlite3.connect(path)
    kinds = [c.split()[1] for c in CHAT_HISTORY.split(", ")]
    con.execute(f"create table if not exists chat_history ({', '.join(COLUMNS)})")
    value = lambda c, k, i: i if c == "id" else float(i) if k == "double" else f"{c}{i}"
    con.executemany(f"insert into chat_history values ({', '.join('?' * len(COLUMNS))})", [[value(c, k, i) for c, k in zip(COLUMNS, kinds, strict=True)] for i in ids])
    con.commit()
    con.close()


def test_batch(spark, tmp_path):
    path = f"{tmp_path}/chat.db"
    fill(path, [*range(5, 105), 1000])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChatHistory)
    rows = spark.read.format("chat_history").option("numPartitions", 7).load(path)
    assert rows.count() == 101 and rows.select("id").distinct().count() == 101 and rows.rdd.getNumPartitions() == 7
    some = rows.where((F.col("id") > 20) & (F.col("id") <= 30) & (F.col("chat_id") != "chat_id25"))
    assert sorted(r.id for r in some.collect()) == [21, 22, 23, 24, 26, 27, 28, 29, 30]
    assert rows.where("id = 1000").first().chat_id == "chat_id1000" and rows.where("id > 5000").count() == 0
    reader = ChatReader({"path": path})
    assert list(reader.pushFilters([GreaterThan(("id",), 20), LessThanOrEqual(("id",), 30), EqualTo(("chat_id",), "x")])) == [EqualTo(("chat_id",), "x")]
    parts = reader.partitions()
    assert min(p.low for p in parts) == 20 and max(p.high for p in parts) == 30 and sum(len(list(reader.read(p))) for p in parts) == 10
    fill(f"{tmp_path}/empty.db", [])
    assert spark.read.format("chat_history").load(f"{tmp_path}/empty.db").count() == 0 and list(reader.read(Ids(0, 0))) == []


def test_stream_reads_no_row_twice(spark, tmp_path):
    """Restarted from its checkpoint, in small batches, over a growing file."""
    path, seen = f"{tmp_path}/chat.db", []
    spark.dataSource.register(ChatHistory)
    for new in (range(1, 41), range(41, 42), [], range(60, 90)):
        fill(path, new)
        stream = spark.readStream.format("chat_history").option("maxIdsPerBatch", 16).load(path)
        q = stream.writeStream.foreachBatch(lambda df, n: seen.extend(r.id for r in df.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(seen) == sorted({*seen}) == [i for i in [*range(1, 42), *range(60, 90)] if i <= max([*new, *seen])]
    assert len(seen) == 71
