"""Episodes: grouping paragraphs, rule-based episodes, queues and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Episode
from ..functions import text as tx
from ..sources.snapshot import cut
from . import matcher
from .dml import first_by
from .fusion import rrf

GRAINS = ("minute", "hour", "day", "month", "year")


def anchor() -> Column:
    """End, start, event, creation, else 0."""
    return F.coalesce("event_time_end", "event_time_start", "event_time", "created_at", F.lit(0.0))


def group(paragraphs: DataFrame, config: Episode = Episode()) -> DataFrame:
    """Adds group_no, in order of anchor within a source: a new group at max_paragraphs, beyond max_chars, or after a gap.

    A gap over window_s always begins a group, so a source is cut there first, by the days that have rows: the pieces are
    folded apart, each over its rows in order, as the rule depends on what a group holds already. Rows arrive sorted and in
    batches, and the state carried on is one group's counters: a piece of any size takes constant memory. A piece's
    groups are numbered after those of the pieces before it.
    """
    rows = paragraphs.select("source", "hash", anchor().alias("anchor"), F.char_length("content").alias("len"))
    day = F.floor(F.col("anchor") / config.window_s).cast("double") if config.window_s > 0 else F.col("anchor")
    rows = cut(rows.withColumn("bin", day))  # no such gap is within a bin
    bins = rows.groupBy("source", "bin").agg(F.min("anchor").alias("lo"), F.max("anchor").alias("hi"))
    w = Window.partitionBy("source").orderBy("bin")  # a row a day
    apart = F.coalesce((F.col("lo") - F.lag("hi").over(w) > config.window_s).cast("int"), F.lit(0))
    bins = bins.withColumn("apart", apart).select(F.col("source").alias("_s"), F.col("bin").alias("_b"), F.sum("apart").over(w).cast("int").alias("piece"))
    rows = rows.join(bins, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b"))).select("source", "piece", "hash", "anchor", "len")
    most, chars, window = config.max_paragraphs, config.max_chars, config.window_s

    def fold(batches):
        import pandas as pd

        source, g, n, c, last = None, 0, 0, 0, 0.0
        for b in batches:
            out = []
            for s, part, h, a, size in zip(b["source"], b["piece"], b["hash"], b["anchor"], b["len"], strict=True):
                size = 0 if pd.isna(size) else int(size)
                key = None if pd.isna(s) else s
                if (key, part) != source:
                    source, g, n, c = (key, part), 0, 0, 0
                elif n and (n >= most or c + size > chars or a - last > window):
                    g, n, c = g + 1, 0, 0
                n, c, last = n + 1, c + size, a
                out.append((key, part, h, a, g))
            yield pd.DataFrame(out, columns=["source", "piece", "hash", "anchor", "group_no"])

    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("piece", T.IntegerType()), T.StructField("hash", T.StringType()), T.StructField("anchor", T.DoubleType()), T.StructField("group_no", T.IntegerType())])
    found = cut(rows.repartition("source", "piece").sortWithinPartitions("source", "piece", "anchor", "hash").mapInPandas(fold, schema))
    before = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    count = found.groupBy("source", "piece").agg((F.max("group_no") + 1).alias("n"))
    first = count.select(F.col("source").alias("_s"), F.col("piece").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("first"))
    j = found.join(first, F.col("source").eqNullSafe(F.col("_s")) & (F.col("piece") == F.col("_p")))
    return j.select("source", "hash", "anchor", (F.col("group_no") + F.col("first")).alias("group_no"))


def group_by_gap(rows: DataFrame, by: str, at: str, gap_s: float) -> DataFrame:
    """E01 by the gap alone: a running count of gaps larger than gap_s."""
    w = Window.partitionBy(by).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap_s).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("group_no", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def time_meta(grouped: DataFrame) -> DataFrame:
    """Per group the interval, the finest grain and the mean confidence in [0, 1]."""
    rank = F.array_position(F.array(*[F.lit(g) for g in GRAINS]), F.coalesce("time_granularity", F.lit("day")))
    start = F.coalesce("event_time_start", "event_time", "event_time_end", "created_at")
    end = F.coalesce("event_time_end", "event_time", "event_time_start", "created_at")
    return grouped.groupBy("source", "group_no").agg(F.min(start).alias("event_time_start"), F.max(end).alias("event_time_end"), F.min_by(F.coalesce("time_granularity", F.lit("day")), rank).alias("time_granularity"), F.avg(F.least(F.greatest(F.coalesce("time_confidence", F.lit(1.0)), F.lit(0.0)), F.lit(1.0))).alias("time_confidence"))


def keywords(grouped: DataFrame, limit: int = 12) -> DataFrame:
    """The most frequent tokens of two or more characters, ties by the first place; grouped(source, group_no, content, ord)."""
    toks = grouped.select("source", "group_no", "ord", F.posexplode(F.regexp_extract_all(F.lower("content"), F.lit(r"([A-Za-z0-9_一-鿿]{2,})"), F.lit(1))).alias("pos", "token"))
    n = toks.where(~F.col("token").isin(*tx.STOP_WORDS)).groupBy("source", "group_no", "token").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("ord").cast("bigint") * (1 << 32) + F.col("pos")).alias("first"))
    w = Window.partitionBy("source", "group_no").orderBy(F.desc("n"), "first", "token")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("source", "group_no", "token", "n", "rank")


def participants(grouped: DataFrame, bridge: DataFrame, entities: DataFrame, limit: int = 16) -> DataFrame:
    """Entity names in order of first appearance, each once whatever the case."""
    j = grouped.select("source", "group_no", "ord", F.col("hash").alias("paragraph_hash")).join(bridge, "paragraph_hash").join(entities.select(F.col("hash").alias("entity_hash"), "name"), "entity_hash")
    first = first_by(j.withColumn("low", F.lower("name")), ["source", "group_no", "low"], F.col("ord"), F.col("name"))
    w = Window.partitionBy("source", "group_no").orderBy("ord", "name")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("source", "group_no", "name", "rank")


def fallback(grouped: DataFrame, bridge: DataFrame, entities: DataFrame, now: float, config: Episode = Episode(), version: str = "1") -> DataFrame:
    """An episode for each group by rule: summary of the first three paragraphs, keywords, participants, interval."""
    keys = ["source", "group_no"]
    g = grouped.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("anchor", "hash")))
    lead3 = g.where("ord <= 3").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", F.substring("content", 1, 140).alias("c")))).alias("x"))
    lead3 = lead3.select(*keys, F.concat_ws(" ", F.transform("x", lambda y: y["c"])).alias("summary"))
    ev = g.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "hash"))), lambda y: y["hash"]).alias("evidence_ids"))  # max_paragraphs at most
    kw = keywords(g, config.max_keywords).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda y: y["token"]).alias("keywords"))
    pp = participants(g, bridge, entities, config.max_participants).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda y: y["name"]).alias("participants"))
    empty = F.array().cast("array<string>")
    j = lead3.join(ev, keys).join(time_meta(g), keys).join(kw, keys, "left").join(pp, keys, "left")
    title = F.concat_ws(" ", F.coalesce("source", F.lit("")), F.concat_ws(", ", F.slice(F.coalesce("keywords", empty), 1, 3)))
    ident = F.to_json(F.struct(F.col("evidence_ids").alias("hashes"), "source", F.lit(version).alias("version")))
    return j.select(
        F.sha2(ident, 256).alias("episode_id"), "source", F.trim(title).alias("title"), "summary", "event_time_start", "event_time_end", "time_granularity", "time_confidence",
        F.coalesce("participants", empty).alias("participants"), F.coalesce("keywords", empty).alias("keywords"), "evidence_ids", F.size("evidence_ids").alias("paragraph_count"),
        F.lit(0.0).alias("llm_confidence"), F.lit("fallback").alias("segmentation_model"), F.lit(version).alias("segmentation_version"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )


def parse_segments(responses: DataFrame, allowed: DataFrame) -> DataFrame:
    """responses(group_id, raw) of a model, allowed(group_id, hash): episodes with title, summary and known hashes; the rest is dropped.

    raw may have text around the first {...}; scores are clamped to [0, 1], lists to 16 participants and 20 keywords.
    """
    shape = "struct<episodes:array<struct<title:string,summary:string,paragraph_hashes:array<string>,participants:array<string>,keywords:array<string>,time_confidence:double,llm_confidence:double>>>"
    body = F.from_json(F.regexp_extract("raw", r"(?s)(\{.*\})", 1), shape)
    e = responses.select("group_id", F.posexplode(body["episodes"]).alias("position", "e")).select("group_id", "position", "e.*")
    known = allowed.groupBy("group_id").agg(F.collect_set("hash").alias("_known"))  # one group's hashes
    empty = F.array().cast("array<string>")
    j = e.join(known, "group_id").withColumn("paragraph_hashes", F.array_distinct(F.filter("paragraph_hashes", lambda h: F.array_contains("_known", h))))
    good = (tx.strip(F.col("title")) != "") & (tx.strip(F.col("summary")) != "") & (F.size("paragraph_hashes") > 0)
    unit = lambda c: tx.clamp(F.col(c), 0.0, 1.0, 0.0).alias(c)
    return j.where(good).select("group_id", "position", tx.strip(F.col("title")).alias("title"), tx.strip(F.col("summary")).alias("summary"), "paragraph_hashes", F.slice(tx.keep_order(F.coalesce("participants", empty)), 1, 16).alias("participants"), F.slice(tx.keep_order(F.coalesce("keywords", empty)), 1, 20).alias("keywords"), unit("time_confidence"), unit("llm_confidence"))


def sources_to_rebuild(paragraphs: DataFrame, episodes: DataFrame) -> DataFrame:
    """E10"""
    return paragraphs.select("source").union(episodes.select("source")).where("source is not null and source != ''").distinct()


def enqueue(queue: DataFrame, sources: DataFrame, now: float, reason: str = "") -> DataFrame:
    """One row a source; a new request sets it to pending with a new time."""
    s = sources.select(tx.strip(F.col("source")).alias("source")).where("source != ''").distinct()
    new = s.select("source", F.lit("pending").alias("status"), F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("last_error"), F.lit(reason).alias("reason"), F.lit(now).alias("requested_at"), F.lit(now).alias("updated_at"))
    return queue.join(s, "source", "left_anti").unionByName(new)


def fetch(queue: DataFrame, limit: int = 20, max_retry: int = 3) -> DataFrame:
    """Pending, or failed with retries left; the oldest request first."""
    ready = (F.col("status") == "pending") | (F.col("status") == "failed") & (F.coalesce("retry_count", F.lit(0)) < max_retry)
    key = "source" if "source" in queue.columns else "paragraph_hash"
    return queue.where(ready).orderBy("requested_at", key).limit(limit)


def settle(queue: DataFrame, outcomes: DataFrame, now: float) -> DataFrame:
    """outcomes(source, requested_at, status, error): a row requested anew meanwhile goes back to pending."""
    o = outcomes.select("source", F.col("requested_at").alias("_r"), F.col("status").alias("_s"), F.col("error").alias("_e"))
    j = queue.join(o, "source", "left")
    hit, newer = F.col("_s").isNotNull(), F.col("requested_at") > F.col("_r")
    return j.select(
        "source",
        F.when(hit & newer & (F.col("_s") != "running"), "pending").when(hit & ~newer, F.col("_s")).otherwise(F.col("status")).alias("status"),
        (F.coalesce("retry_count", F.lit(0)) + F.when(hit & ~newer & (F.col("_s") == "failed"), 1).otherwise(0)).cast("int").alias("retry_count"),
        F.when(hit & ~newer & (F.col("_s") == "failed"), F.substring("_e", 1, 500)).when(hit & ~newer, F.lit(None)).otherwise(F.col("last_error")).alias("last_error"),
        "reason", "requested_at", F.when(hit, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def lexical(episodes: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """4 for the title, 3 for keywords, 2 for the summary, 1 for participants that contain the query's text."""
    q = queries.select("query_id", F.lower(F.trim("text")).alias("t")).where("t != ''")
    parts = [(4, F.col("title")), (3, F.concat_ws(" ", "keywords")), (2, F.col("summary")), (1, F.concat_ws(" ", "participants"))]
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lower(c).alias("t")) for w, c in parts])).alias("x")
    texts = episodes.select("episode_id", each).select(F.struct("episode_id", "x.w").alias("id"), "x.t")
    hits = matcher.held(texts, q, "id", "t", "t").select("id.episode_id", "id.w", F.col("pattern").alias("t"))
    found = q.join(hits, "t").groupBy("query_id", "episode_id").agg(F.sum("w").cast("double").alias("score"))
    j = found.join(episodes.select("episode_id", "event_time_end", "updated_at"), "episode_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("event_time_end"), F.desc("updated_at"), "episode_id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "episode_id", "score", "rank")


def evidence_rank(matched: DataFrame, hits: DataFrame, column: str) -> DataFrame:
    """Episodes in order of the best rank among their matched items; hits(query_id, hash, rank)."""
    m = matched.select("query_id", "episode_id", F.explode(column).alias("hash")).join(hits.select("query_id", "hash", "rank"), ["query_id", "hash"])
    return m.groupBy("query_id", "episode_id").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n")).select("query_id", F.col("episode_id").alias("hash"), (-F.col("best") + F.col("n") * 1e-6).alias("score"))


def fuse(branches: list[tuple[DataFrame, float]], episodes: DataFrame, k: int = 5, rrf_k: int = 60) -> DataFrame:
    """Weighted reciprocal ranks over lexical, paragraph and relation evidence; ties by update, then id."""
    every = rrf([(df.select("query_id", F.col("hash"), "score"), w) for df, w in branches], rrf_k, normalize=False)
    j = every.join(episodes.select(F.col("episode_id").alias("hash"), "updated_at"), "hash")
    win = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("updated_at"), "hash")
    return j.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= k).select("query_id", F.col("hash").alias("episode_id"), "score", "rank")
