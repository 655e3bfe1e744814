"""Keyed state with timers: a work queue with leases, and requests that share a running answer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEASE_S, MAX_RETRY = 600.0, 3
EXPIRED = "lease expired"
QUEUE = "source string, status string, requested_at double, retry_count int, last_error string, updated_at double"
COLUMNS = [c.split()[0] for c in QUEUE.split(", ")]
#: What transformWithState needs of a session.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def enable(spark: SparkSession) -> None:
    """Keyed state on disk; to be called before a query with state starts."""
    spark.conf.set(*PROVIDER)


def replay(events: DataFrame, now: float, lease_s: float = LEASE_S) -> DataFrame:
    """events(source, kind, at, run, error) to one row a source, as of `now`.

    kind is request, start, done or fail; run is the time of the start that a done or fail ends (and of the start itself).
    The newest request counts: done if an attempt that began at or after it is done; else its last attempt decides:
    failed, or failed because its lease ran out, or running; without one it is running while an older attempt still holds
    its lease, else pending. The result is a function of the set of events: late and repeated ones change nothing else.
    """
    req = events.where("kind = 'request'").groupBy("source").agg(F.max("at").alias("requested_at"))
    tries = events.where("kind != 'request' and run is not null").groupBy("source", "run").agg(
        F.max(F.col("kind") == "start").alias("started"), F.max(F.col("kind") == "done").alias("done"), F.max(F.col("kind") == "fail").alias("failed"), F.max(F.when(F.col("kind") == "fail", F.coalesce("error", F.lit("")))).alias("error"),
    )
    lost = ~F.col("done") & ~F.col("failed") & (F.col("run") + lease_s <= now)
    tries = tries.select("source", "run", "done", (~F.col("done") & (F.col("failed") | lost)).alias("bad"), F.when(F.col("failed"), F.col("error")).when(lost, EXPIRED).alias("error"))
    j = req.join(tries, "source", "left")
    mine = F.col("run") >= F.col("requested_at")
    last = F.max_by(F.struct("bad", "error"), F.when(mine, F.col("run")))
    g = j.groupBy("source", "requested_at").agg(
        F.coalesce(F.bool_or(mine & F.col("done")), F.lit(False)).alias("any_done"), F.count_if(mine & F.col("bad")).cast("int").alias("retry_count"), last.alias("last"),
        F.coalesce(F.bool_or(~mine & ~F.col("done") & ~F.col("bad")), F.lit(False)).alias("held"),
    )
    status = F.when(F.col("any_done"), "done").when(F.col("last.bad"), "failed").when(F.col("last").isNotNull() | F.col("held"), "running").otherwise("pending")
    g = g.withColumn("status", status)
    return g.select("source", "status", "requested_at", "retry_count", F.when(F.col("status") == "failed", F.col("last.error")).alias("last_error"), F.lit(now).alias("updated_at"))


def _merge(state: dict, e: Row) -> None:
    """Adds an event to a source's state: its newest request, and per run whether it is done or failed."""
    if e.kind == "request":
        state["at"] = e.at if state["at"] is None else max(state["at"], e.at)
    elif e.run is not None:
        end = state["runs"].setdefault(repr(e.run), [False, None])
        if e.kind == "done":
            end[0] = True
        elif e.kind == "fail":
            end[1] = max(end[1] or "", e.error or "")
    if state["at"] is not None:  # attempts before the newest request matter only while they run
        state["runs"] = {r: x for r, x in state["runs"].items() if float(r) >= state["at"] or not (x[0] or x[1] is not None)}


def _told(source: str, state: dict, now: float, lease_s: float) -> tuple | None:
    """The row that replay() would give, or None before any request."""
    if state["at"] is None:
        return None
    runs = sorted((float(r), *x) for r, x in state["runs"].items())
    bad = lambda x: not x[1] and (x[2] is not None or x[0] + lease_s <= now)
    mine = [x for x in runs if x[0] >= state["at"]]
    held = any(not x[1] and not bad(x) for x in runs if x[0] < state["at"])
    status = "done" if any(x[1] for x in mine) else "failed" if mine and bad(mine[-1]) else "running" if mine or held else "pending"
    error = (EXPIRED if mine[-1][2] is None else mine[-1][2]) if status == "failed" else None
    return source, status, state["at"], sum(map(bad, mine)), error, now


class _Queue(StatefulProcessor):
    """State of a source: its newest request and the attempts that matter to it; a timer for each lease."""

    def __init__(self, lease_s: float):
        self.lease_s = lease_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("queue", "body string, now double")

    def _load(self) -> tuple[dict, float]:
        held = self.state.get()
        return (json.loads(held[0]), held[1]) if held is not None else ({"at": None, "runs": {}}, 0.0)

    def _save(self, key: tuple, state: dict, now: float) -> Iterator[Row]:
        self.state.update((json.dumps(state), now))
        told = _told(key[0], state, now, self.lease_s)
        if told is not None:
            yield Row(**dict(zip(COLUMNS, told, strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, now = self._load()
        for e in rows:
            _merge(state, e)
            now = max(now, e.at)
            if e.kind == "start" and e.run is not None:
                self.handle.registerTimer(int((e.run + self.lease_s) * 1000))
        yield from self._save(key, state, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, now = self._load()
        yield from self._save(key, state, max(now, expiredTimerInfo.getExpiryTimeInMs() / 1000))

    def close(self) -> None:
        pass


def queue(events: DataFrame, lease_s: float = LEASE_S, late: str = "1 hour") -> DataFrame:
    """A stream of events(source, kind, at, run, error) to the rows of the queue as they change (update mode).

    A source's last row is what replay() gives at its `updated_at`. When the watermark passes the end of a lease without a
    done or fail, the timer reports the attempt as failed. State holds the newest request and the attempts since, and is
    as large as the sources that ever asked.
    """
    enable(events.sparkSession)
    stamped = events.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    return stamped.groupBy("source").transformWithState(_Queue(lease_s), QUEUE, "Update", "EventTime")


class _Flight(StatefulProcessor):
    """State of a key: the answer and when it was asked for."""

    def __init__(self, execute: Callable[[str, str | None], str], ttl_s: float):
        self.execute, self.ttl_s = execute, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("answer", "answer string, at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()
        for r in rows:  # one at a time: a hot key takes constant memory
            leads = held is None or not abs(r.at - held[1]) < self.ttl_s
            if leads:
                answer = self.execute(key[0], r.payload)
                if held is None or r.at > held[1]:
                    held = (answer, r.at)
                    self.state.update(held)
                    self.handle.registerTimer(int((r.at + self.ttl_s) * 1000))
            else:
                answer = held[0]
            yield Row(request_id=r.request_id, request_key=key[0], answer=answer, led=leads)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        if held is not None and (held[1] + self.ttl_s) * 1000 <= expiredTimerInfo.getExpiryTimeInMs() + 1:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def single_flight(requests: DataFrame, execute: Callable[[str, str | None], str], ttl_s: float = 2.0, late: str = "10 seconds") -> DataFrame:
    """A stream of requests(request_key, request_id, at, payload) to (request_id, request_key, answer, led): one row each.

    The first request of a key runs execute(key, payload); requests of the key within ttl_s of it get the same answer, in
    this micro-batch or a later one. An answer is dropped when the watermark passes its time to live.
    """
    enable(requests.sparkSession)
    stamped = requests.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    kind = requests.schema["request_id"].dataType.simpleString()
    return stamped.groupBy("request_key").transformWithState(_Flight(execute, ttl_s), f"request_id {kind}, request_key string, answer string, led boolean", "Append", "EventTime")
