"""The work queue and shared answers: streams against replays."""

import random

import pytest
from memspark.streaming import work

E = "source string, kind string, at double, run double, error string"
R = "request_key string, request_id int, at double, payload string"


def brute(events, now, lease):
    out = {}
    for s in {e[0] for e in events}:
        mine = [e for e in events if e[0] == s]
        asked = [e[2] for e in mine if e[1] == "request"]
        if not asked:
            continue
        r, runs = max(asked), {}
        for _, kind, _, run, error in mine:
            if kind != "request":
                x = runs.setdefault(run, {"done": False, "fail": None})
                if kind == "done":
                    x["done"] = True
                if kind == "fail":
                    x["fail"] = max(x["fail"] or "", error or "")
        why = lambda run: None if runs[run]["done"] else runs[run]["fail"] if runs[run]["fail"] is not None else work.EXPIRED if run + lease <= now else None  # noqa: B023, E731
        since = sorted(x for x in runs if x >= r)
        if any(runs[x]["done"] for x in since):
            status = "done"
        elif since:
            status = "running" if why(since[-1]) is None else "failed"
        else:
            status = "running" if any(not runs[x]["done"] and why(x) is None for x in runs) else "pending"
        out[s] = (status, r, sum(why(x) is not None for x in since), why(since[-1]) if status == "failed" else None)
    return out


def story(seed, n=12):
    r, events = random.Random(seed), []
    for i in range(n):
        at = float(r.randrange(100))
        for _ in range(r.randint(1, 4)):
            events.append((f"s{i}", "request", at, None, None))
            for _ in range(r.randint(0, 3)):
                at += r.randint(1, 40)
                events.append((f"s{i}", "start", at, at, None))
                run, end = at, r.choice(("done", "fail", "fail", None, None))
                at += r.randint(1, 300)
                if end:
                    events.append((f"s{i}", end, at, run, r.choice(("boom", None)) if end == "fail" else None))
            at += r.randint(1, 200)
    return [*events, ("idle", "start", 5.0, 5.0, None)]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_replay(spark, seed):
    events = story(seed)
    for now in (150.0, 10_000.0):
        got = {x.source: (x.status, x.requested_at, x.retry_count, x.last_error) for x in work.replay(spark.createDataFrame(events + events[::3], E), now, 100.0).collect()}
        assert got == brute(events, now, 100.0)


def run_stream(spark, tmp_path, batches, ddl, build, mode):
    """The rows that a stream gives over the batches, one run each, from one checkpoint."""
    log, out = f"{tmp_path}/log", []
    spark.createDataFrame([], ddl).write.parquet(log)
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(log)
        q = build(spark.readStream.schema(ddl).parquet(log)).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").foreachBatch(lambda df, n: out.extend(df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
    return out


def test_queue_of_late_and_replayed_events(spark, tmp_path):
    """Shuffled, repeated and late events over several batches end in the rows that a replay of all gives; leases run out by the watermark."""
    events = story(7, 6)
    mixed = events + events[::4]
    random.Random(1).shuffle(mixed)
    end = [("clock", "request", 50_000.0, None, None)]
    out = run_stream(spark, tmp_path, [mixed[: len(mixed) // 2], mixed[len(mixed) // 2 :], end, [("clock", "request", 90_000.0, None, None)]], E, lambda s: work.queue(s, 100.0, "1000 seconds"), "update")
    last = {}
    for x in out:
        last[x.source] = (x.status, x.requested_at, x.retry_count, x.last_error)
    want = brute(events + end + [("clock", "request", 90_000.0, None, None)], 80_000.0, 100.0)
    assert {s: v for s, v in last.items() if s != "clock"} == {s: v for s, v in want.items() if s != "clock"}
    assert any(v[3] == work.EXPIRED for v in last.values())


def test_every_request_gets_an_answer(spark, tmp_path):
    """Within the time to live the executor runs once for a key, over batches too."""
    calls = f"{tmp_path}/calls"

    def execute(key, payload):
        with open(calls, "a") as f:
            f.write(f"{key}\n")
        return f"{key}:{payload}"

    one = [("a", i, 10.0 + i / 100, f"p{i}") for i in range(50)] + [("b", 100, 10.0, None)]
    two = [("a", 200, 11.0, "late"), ("a", 201, 13.0, "new"), ("b", 202, 10.5, "x")]
    three = [("a", 300, 13.5, "y"), ("c", 301, 60.0, "z")]
    out = run_stream(spark, tmp_path, [one, two, three], R, lambda s: work.single_flight(s, execute, 2.0), "append")
    got = {x.request_id: x.answer for x in out}
    assert len(out) == len(got) == 56 and len({got[i] for i in (*range(50), 200)}) == 1
    assert got[100] == got[202] == "b:None" and got[201] == got[300] == "a:new" and got[301] == "c:z"
    assert sorted(open(calls).read().split()) == ["a", "a", "b", "c"] and sum(x.led for x in out) == 4
