"""Structured Streaming jobs over append-only change logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import episode
from ..sources.snapshot import Snapshots, cut


def single_flight(requests: DataFrame, ttl: str = "2 seconds") -> DataFrame:
    """requests(request_key, ts, ...): the first of each key within the ttl."""
    return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["request_key"])


def reinforce_buffer(hits: DataFrame, tick: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """hits(hash, ts): the relations of each tick, each once, with their number of hits."""
    return hits.withWatermark("ts", late).groupBy(F.window("ts", tick).alias("tick"), "hash").agg(F.count(F.lit(1)).alias("hits"))


def run(stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, name: str | None = None) -> StreamingQuery:
    """A job for each micro-batch; every: a processing interval, or None for all there is and then an end."""
    w = stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint)
    w = w.queryName(name) if name else w
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def rebuild_episodes(snapshots: Snapshots, now: Callable[[], float]) -> Callable[[DataFrame, int], None]:
    """Changed paragraphs(source) of a batch: their sources are grouped anew and their episodes replaced.

    Only the buckets of the changed sources and of their episodes are rewritten; a batch that is replayed replaces the same
    episodes by the same.
    """

    def job(batch: DataFrame, _: int) -> None:
        store = snapshots.store()
        t = now()
        sources = cut(batch.select("source").where("source is not null and source != ''").distinct())
        p = store["paragraph"].where("not coalesce(is_deleted, false)").join(sources, "source", "left_semi")
        grouped = p.join(episode.group(p).select("hash", "anchor", "group_no"), "hash")
        made = episode.fallback(grouped, store["paragraph_entity"], store["entity"], t)
        mine = snapshots.read("episode", buckets=snapshots.buckets_of("episode", sources)).join(sources, "source", "left_semi")
        old = cut(mine.select("episode_id", F.col("created_at").alias("_c")))
        made = cut(made.join(old, "episode_id", "left").withColumn("created_at", F.coalesce("_c", "created_at")).drop("_c").select(*store["episode"].columns))
        links = made.select("episode_id", F.posexplode("evidence_ids").alias("position", "paragraph_hash")).select("episode_id", "paragraph_hash", "position")
        queue = snapshots.read("rebuild_source", buckets=snapshots.buckets_of("rebuild_source", sources)).join(sources, "source", "left_semi")
        queue = episode.enqueue(queue, sources, t, "paragraphs changed")
        done = queue.select("source", "requested_at", F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"))
        snapshots.change(
            upserts={"rebuild_source": episode.settle(queue, done, t), "episode_paragraph": links},
            deletes={"episode_paragraph": old.select("episode_id")},
            replaces={"episode": (sources, made)},
            note="episodes",
        )

    return job


def import_chats(snapshots: Snapshots, now: Callable[[], float]) -> Callable[[DataFrame, int], None]:
    """Each batch of chat history becomes one snapshot, which rewrites the buckets of its own rows; the stream's checkpoint is the cursor, and a replay adds nothing."""
    from ..sources import ingest

    def job(batch: DataFrame, _: int) -> None:
        mapped = ingest.map_chats(batch)
        touched = ingest.touched(snapshots, mapped["items"], mapped["relations"])
        store = {t: snapshots.read(t, buckets=b) for t, b in touched.items()}
        out = ingest.commit_window(store, mapped, now())
        snapshots.commit({t: out[t] for t in touched}, "chat history", buckets=touched)

    return job
