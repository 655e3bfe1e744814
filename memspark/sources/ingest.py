"""Ingest: JSON shapes, items, chunks to paragraphs, entities and relations; task progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import time as tm
from ..operators.dml import insert_relations, link, link_mentions, merge_entities, upsert_paragraphs

ITEM = "struct<content:string,type:string,knowledge_type:string,source:string,time_meta:struct<event_time:string,event_time_start:string,event_time_end:string,time_range:array<string>,time_granularity:string,time_confidence:string>,entities:array<string>,relations:array<struct<subject:string,predicate:string,object:string>>>"


def json_shape(raw: Column) -> Column:
    """Openie, script_json or web_json, by the keys of the document."""
    has = lambda k: F.get_json_object(raw, f"$.{k}").isNotNull()
    return F.when(has("docs"), "openie").when(has("paragraphs") & (has("entities") | has("relations")), "script_json").when(has("paragraphs"), "web_json").otherwise("unknown")


def json_units(files: DataFrame) -> dict[str, DataFrame]:
    """files(path, raw) to paragraphs (items or bare strings), entities and relations."""
    body = F.from_json("raw", "paragraphs array<string>, entities array<string>, relations array<struct<subject:string,predicate:string,object:string>>, docs array<struct<passage:string,extracted_triples:array<array<string>>,extracted_entities:array<string>>>")
    f = files.select("path", json_shape(F.col("raw")).alias("shape"), body.alias("b"))
    item = F.when(F.col("p").startswith("{"), F.from_json("p", ITEM))
    p = f.where("shape != 'openie'").select("path", F.posexplode("b.paragraphs").alias("ord", "p")).select("path", "ord", F.coalesce(item["content"], F.when(~F.col("p").startswith("{"), F.col("p"))).alias("content"), item.alias("item"))
    d = f.where("shape = 'openie'").select("path", F.posexplode("b.docs").alias("ord", "d"))
    empty = F.array().cast("array<string>")
    triple = "array<struct<subject:string,predicate:string,object:string>>"
    of_docs = F.transform(F.filter(F.coalesce("d.extracted_triples", F.array().cast("array<array<string>>")), lambda t: F.size(t) == 3), lambda t: F.struct(t[0].alias("subject"), t[1].alias("predicate"), t[2].alias("object")))
    paragraphs = p.select("path", "ord", "content", F.coalesce("item.knowledge_type", "item.type").alias("knowledge_type"), F.col("item.source").alias("source"), F.col("item.time_meta").alias("time_meta"), F.coalesce("item.entities", empty).alias("entities"), F.coalesce("item.relations", F.array().cast(triple)).alias("relations"))
    docs = d.select("path", "ord", F.col("d.passage").alias("content"), F.lit(None).cast("string").alias("knowledge_type"), F.lit(None).cast("string").alias("source"), F.lit(None).cast(dict(paragraphs.dtypes)["time_meta"]).alias("time_meta"), F.coalesce("d.extracted_entities", empty).alias("entities"), of_docs.alias("relations"))
    return {
        "paragraphs": normalize_items(paragraphs.unionByName(docs)),
        "entities": f.select("path", F.explode("b.entities").alias("name")).where(tx.strip(F.col("name")) != ""),
        "relations": f.select("path", F.inline("b.relations")).where("subject != '' and predicate != '' and object != ''"),
    }


def normalize_items(items: DataFrame, default_source: str = "web_import") -> DataFrame:
    """Items without content are left out; entities each once whatever the case; relations need all three parts; types are resolved."""
    whole = F.filter(F.coalesce("relations", F.array().cast("array<struct<subject:string,predicate:string,object:string>>")), lambda r: (tx.strip(r["subject"]) != "") & (tx.strip(r["predicate"]) != "") & (tx.strip(r["object"]) != ""))
    kind = F.coalesce(tx.stored_type(F.coalesce("knowledge_type", F.lit("")), F.col("content"), legacy=True, fallback="mixed"), F.lit("mixed"))
    out = items.where(tx.strip(F.col("content")) != "").withColumns({"content": tx.normalize(F.col("content")), "knowledge_type": kind, "source": F.coalesce(F.nullif(tx.strip(F.col("source")), F.lit("")), F.lit(default_source)), "entities": tx.keep_order("entities"), "relations": whole})
    if "time_meta" in items.columns:
        t = F.col("time_meta")
        meta = tm.time_meta(t["event_time"], t["event_time_start"], t["event_time_end"], F.get(t["time_range"], F.lit(0)), F.get(t["time_range"], F.lit(1)), t["time_granularity"], t["time_confidence"])
        out = out.withColumn("time", F.when(t.isNotNull(), meta)).drop("time_meta")
    return out


def extract_regex(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chunks(hash, content): names and quoted strings as entities, "X is Y" as relations."""
    names = F.array_distinct(F.concat(F.regexp_extract_all("content", F.lit("([A-Z][a-z]+)"), F.lit(1)), F.regexp_extract_all("content", F.lit("""["']([^"']+)["']"""), F.lit(1))))
    e = chunks.select("hash", F.explode(F.filter(names, lambda x: tx.strip(x) != "")).alias("name"))
    pattern = r"([A-Z][a-z]+)\s+(is|was|are|were)\s+([A-Z][a-z]+)"
    parts = [F.regexp_extract_all("content", F.lit(pattern), F.lit(i)).alias(c) for i, c in ((1, "subject"), (2, "predicate"), (3, "object"))]
    r = chunks.select("hash", F.inline(F.arrays_zip(*parts)))
    return e, r


def persist(store: dict[str, DataFrame], items: DataFrame, now: float) -> dict[str, DataFrame]:
    """items(content, source, knowledge_type, entities, relations, ord) into paragraphs, entities (with the ends of relations), relations and bridges."""
    keyed = items.withColumn("hash", tx.content_hash(tx.normalize(F.col("content"))))
    names = keyed.select("hash", "ord", F.explode(tx.keep_order("entities")).alias("name"))
    rel = keyed.select("hash", "ord", F.inline("relations"))
    ends = rel.select("hash", "ord", F.explode(F.array("subject", "object")).alias("name"))
    every = names.unionByName(ends)
    mentions = every.where(tx.canonical(F.col("name")) != "").groupBy(F.col("hash").alias("paragraph_hash"), tx.entity_hash(F.col("name")).alias("entity_hash")).agg(F.count(F.lit(1)).cast("int").alias("mention_count"))
    new_rel = rel.withColumns({"confidence": F.lit(1.0), "source_paragraph": F.col("hash"), "created_at": F.lit(now), "vector_state": F.lit("none")}).drop("hash")
    bridge = rel.select(F.col("hash").alias("paragraph_hash"), tx.relation_hash(F.col("subject"), F.col("predicate"), F.col("object")).alias("relation_hash"))
    return store | {
        "paragraph": upsert_paragraphs(store["paragraph"], items.drop("entities", "relations"), now),
        "entity": merge_entities(store["entity"], every.select("name", "ord"), now),
        "relation": insert_relations(store["relation"], new_rel),
        "paragraph_entity": link_mentions(store["paragraph_entity"], mentions),
        "paragraph_relation": link(store["paragraph_relation"], bridge),
    }


def touched(snapshots, items: DataFrame, relations: DataFrame | None = None) -> dict[str, list[int]]:
    """The buckets of each table that persist() can change for these items and relations."""
    p = items.select(tx.content_hash(tx.normalize(F.col("content"))).alias("hash"))
    rel = relations if relations is not None else items.select(F.inline("relations")).select("subject", "predicate", "object")
    names = items.select(F.explode(tx.keep_order("entities")).alias("name")).unionByName(rel.select(F.explode(F.array("subject", "object")).alias("name")))
    keys = {
        "paragraph": p,
        "entity": names.select(tx.entity_hash(F.col("name")).alias("hash")),
        "relation": rel.select(tx.relation_hash(F.col("subject"), F.col("predicate"), F.col("object")).alias("hash")),
        "paragraph_entity": p.withColumnRenamed("hash", "paragraph_hash"),
        "paragraph_relation": p.withColumnRenamed("hash", "paragraph_hash"),
    }
    return {t: snapshots.buckets_of(t, k) for t, k in keys.items()}


def map_chats(rows: DataFrame) -> dict[str, DataFrame]:
    """Chat history to paragraphs with a minute-grain interval, entities, and relations participant-theme and theme-keyword (8 at most).

    A list field that is no JSON list sends its row to `rejected`.
    """
    part, keys = F.from_json("participants", "array<string>"), F.from_json("keywords", "array<string>")
    ok = F.coalesce(part.isNotNull() & keys.isNotNull() & (tx.strip(F.coalesce("summary", F.lit(""))) != ""), F.lit(False))
    r = rows.where(ok).withColumns({"p": tx.keep_order(part), "k": F.slice(tx.keep_order(keys), 1, 8), "theme": tx.strip(F.col("theme"))})
    content = F.concat_ws("\n", F.nullif("theme", F.lit("")), tx.strip(F.col("summary")))
    items = r.select(F.col("id").alias("ord"), content.alias("content"), F.concat_ws(":", F.lit("chat_history"), "chat_id").alias("source"), F.lit("narrative").alias("knowledge_type"), F.col("start_time").alias("event_time_start"), F.col("end_time").alias("event_time_end"), F.lit("minute").alias("time_granularity"), F.lit(0.95).alias("time_confidence"), tx.keep_order(F.concat("p", F.array("theme"), "k")).alias("entities"))
    a = r.where("theme != ''").select(F.col("id").alias("ord"), F.explode("p").alias("subject"), F.lit("discussed").alias("predicate"), F.col("theme").alias("object"))
    b = r.where("theme != ''").select(F.col("id").alias("ord"), F.col("theme").alias("subject"), F.lit("has_keyword").alias("predicate"), F.explode("k").alias("object"))
    return {"items": items, "relations": a.unionByName(b), "rejected": rows.where(~ok)}


def commit_window(store: dict[str, DataFrame], mapped: dict[str, DataFrame], now: float) -> dict[str, DataFrame]:
    """One window of chats; only paragraphs new to the store count entities, so a replay changes nothing."""
    keyed = mapped["items"].withColumn("hash", tx.content_hash(tx.normalize(F.col("content")))).join(store["paragraph"].select("hash"), "hash", "left_anti").drop("hash")
    rel = mapped["relations"].groupBy("ord").agg(F.collect_list(F.struct("subject", "predicate", "object")).alias("relations"))
    none = F.array().cast("array<struct<subject:string,predicate:string,object:string>>")
    return persist(store, keyed.join(rel, "ord", "left").withColumn("relations", F.coalesce("relations", none)), now)


def high_water(rows: DataFrame) -> DataFrame:
    """The last id, as the cursor of the next window."""
    return rows.agg(F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n"))


def verify(sample: DataFrame, store: dict[str, DataFrame]) -> DataFrame:
    """Sampled items that have no paragraph, and those without a vector."""
    k = sample.select(tx.content_hash(tx.normalize(F.col("content"))).alias("hash")).distinct()
    out = None
    for name, table in (("paragraph", store["paragraph"]), ("vector", store["vector"])):
        row = k.join(table.select("hash"), "hash", "left_anti").agg(F.lit(name).alias("missing_in"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def summarize_streams(messages: DataFrame, last: int = 50) -> DataFrame:
    """messages(stream_id, at, text): the last messages of a stream with their interval, as input for a summary."""
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id").orderBy(F.desc("at"), F.desc("text"))
    r = messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    return r.groupBy("stream_id").agg(F.min("at").alias("event_time_start"), F.max("at").alias("event_time_end"), F.count(F.lit(1)).alias("n"), F.array_join(lines, "\n").alias("transcript"))


def first_json(c: Column) -> Column:
    """The first {...} block of a model's answer."""
    return F.regexp_extract(c, r"(?s)(\{.*\})", 1)


def progress(chunks: DataFrame) -> DataFrame:
    """chunks(task_id, file_id, status) to a task's counts and clamped ratio."""
    done = F.count_if(F.col("status") == "completed")
    failed, total = F.count_if(F.col("status") == "failed"), F.count(F.lit(1))
    return chunks.groupBy("task_id").agg(total.alias("total"), done.alias("done"), failed.alias("failed"), F.count_if(F.col("status") == "cancelled").alias("cancelled"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (done + failed) / total)).alias("ratio"))


def final_status(tasks: DataFrame) -> DataFrame:
    """Cancelled if anything is, completed_with_errors if anything failed, else completed."""
    return tasks.withColumn("status", F.when(F.col("cancelled") > 0, "cancelled").when(F.col("failed") > 0, "completed_with_errors").otherwise("completed"))


def retry_plan(chunks: DataFrame) -> DataFrame:
    """chunks(file_id, status, failed_at, retryable): per failed file chunk_retry, file_fallback (failed before chunks), or skipped."""
    f = chunks.groupBy("file_id").agg(F.count_if(F.expr("status = 'failed' and failed_at = 'extracting' and retryable")).alias("again"), F.count_if(F.expr("status = 'failed'")).alias("failed"), F.count_if(F.expr("status = 'failed' and failed_at != 'extracting'")).alias("early"))
    return f.where("failed > 0").select("file_id", F.when(F.col("early") > 0, "file_fallback").when(F.col("again") > 0, "chunk_retry").otherwise("skipped").alias("plan"), "again", "failed")


