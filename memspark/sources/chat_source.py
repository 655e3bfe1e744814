"""Chat history in a SQLite file as a data source: partitioned batch reads with pushed id ranges, and a stream of what is appended."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .readers import CHAT_HISTORY

COLUMNS = [c.split()[0] for c in CHAT_HISTORY.split(", ")]


@dataclass
class Ids(InputPartition):
    """Rows with low < id <= high."""

    low: int
    high: int


class _Table:
    """The table of the options `path` and `table`; every task opens the file for itself, read-only."""

    def __init__(self, options: dict):
        self.path, self.table, self.parts = options["path"], options.get("table", "chat_history"), int(options.get("numpartitions", 16))
        self.per_batch = int(options.get("maxidsperbatch", 1 << 40))
        if not self.table.isidentifier():
            raise ValueError(f"no table name: {self.table}")

    def _ask(self, sql: str, *args) -> sqlite3.Cursor:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True).execute(sql, args)

    def extent(self) -> tuple[int, int]:
        low, high = self._ask(f"select min(id), max(id) from {self.table}").fetchone()
        return (0, 0) if low is None else (low - 1, high)

    def rows(self, part: Ids) -> Iterator[tuple]:
        yield from self._ask(f"select {', '.join(COLUMNS)} from {self.table} where id > ? and id <= ? order by id", part.low, part.high)

    def split(self, low: int, high: int) -> list[Ids]:
        """At most `parts` ranges of about the same width."""
        n = max(1, min(self.parts, high - low))
        cuts = [low + (high - low) * k // n for k in range(n + 1)]
        return [Ids(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class ChatReader(DataSourceReader):
    """Ids outside of the pushed bounds are not read; other filters are left to Spark."""

    def __init__(self, options: dict):
        self.t, self.low, self.high = _Table(options), None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            bound = {GreaterThan: (0, None), GreaterThanOrEqual: (-1, None), LessThan: (None, -1), LessThanOrEqual: (None, 0), EqualTo: (-1, 0)}.get(type(f))
            if bound is None or f.attribute != ("id",) or not isinstance(f.value, int):
                yield f
                continue
            if bound[0] is not None:
                self.low = max(f.value + bound[0], self.low if self.low is not None else f.value + bound[0])
            if bound[1] is not None:
                self.high = min(f.value + bound[1], self.high if self.high is not None else f.value + bound[1])

    def partitions(self) -> list[InputPartition]:
        low, high = self.t.extent()
        low, high = low if self.low is None else max(low, self.low), high if self.high is None else min(high, self.high)
        return self.t.split(low, high) or [Ids(0, 0)]

    def read(self, partition: Ids) -> Iterator[tuple]:
        return self.t.rows(partition)


class ChatStream(DataSourceStreamReader):
    """Offsets are ids: a batch is the rows after the last batch's id, up to the largest there is, or to maxIdsPerBatch more."""

    def __init__(self, options: dict):
        self.t, self.at = _Table(options), None

    def initialOffset(self) -> dict:
        return {"id": self.t.extent()[0]}

    def latestOffset(self) -> dict:
        low, high = self.t.extent()
        start = low if self.at is None else self.at
        self.at = max(start, min(high, start + self.t.per_batch))
        return {"id": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end["id"]
        return self.t.split(start["id"], end["id"])

    def read(self, partition: Ids) -> Iterator[tuple]:
        return self.t.rows(partition)

    def commit(self, end: dict) -> None:
        """The checkpoint keeps the offset; the file is not changed."""


class ChatHistory(DataSource):
    """spark.dataSource.register(ChatHistory); spark.read or readStream.format("chat_history").load(path).

    Options: table, numPartitions, maxIdsPerBatch. The file must be where all executors can open it. Rows are appended with
    growing ids; filters on id are pushed down if spark.sql.python.filterPushdown.enabled is true.
    """

    @classmethod
    def name(cls) -> str:
        return "chat_history"

    def schema(self) -> str:
        return CHAT_HISTORY

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChatReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ChatStream(dict(self.options))
