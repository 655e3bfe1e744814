"""Writes, upserts and deletes as functions from snapshot to snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import KNOWLEDGE_TYPES, VECTOR_STATES
from ..sources.snapshot import cut
from . import graph


def align(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with the columns and types of `like`; what is missing is null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType.simpleString()).alias(f.name) for f in like.schema])


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def update(df: DataFrame, keys: DataFrame, on: str, **values: Column) -> DataFrame:
    """Sets columns of the rows whose key is in `keys`; values may use columns of both."""
    marked = df.join(keys.withColumn("_hit", F.lit(True)), on, "left")
    hit = F.col("_hit").isNotNull()
    extra = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}
    return marked.withColumns(extra).select(*df.columns)


def upsert_paragraphs(existing: DataFrame, incoming: DataFrame, now: float) -> DataFrame:
    """incoming(content, source, ..., ord). The first row of a hash stays; a soft-deleted one comes back to life.

    Texts are normalised and hashed once, into a table. The first rows are chosen by hash, order and place there; only the
    texts of new hashes are joined again.
    """
    keyed = incoming.withColumn("content", tx.normalize(F.col("content")))
    keyed = cut(keyed.withColumns({"hash": F.coalesce(tx.content_hash(F.col("content")), F.lit("")), "_row": F.monotonically_increasing_id()}))
    first = cut(keyed.groupBy("hash").agg(F.min(F.struct("ord", "_row")).alias("k")).select("hash", F.col("k._row").alias("_row")))
    fresh = first.join(existing.select("hash"), "hash", "left_anti").select("_row")
    filled = {c: v for c, v in {"created_at": F.lit(now), "updated_at": F.lit(now), "is_deleted": F.lit(False), "access_count": F.lit(0), "word_count": tx.word_count(F.col("content"))}.items() if c not in incoming.columns}
    new = align(keyed.join(fresh, "_row", "left_semi").withColumns(filled), existing)
    alive = update(existing, first.select("hash"), "hash", is_deleted=F.lit(False), deleted_at=F.lit(None).cast("double"))
    return alive.unionByName(new)


def merge_entities(existing: DataFrame, names: DataFrame, now: float) -> DataFrame:
    """names(name, ord). Counts appearances, keeps the first spelling, revives."""
    new = names.withColumn("hash", tx.entity_hash(F.col("name"))).where(tx.canonical(F.col("name")) != "")
    new = new.groupBy("hash").agg(F.count(F.lit(1)).alias("more"), F.min_by("name", F.struct("ord", "name")).alias("new_name"))
    both = existing.join(new, "hash", "full_outer")
    seen = F.col("more").isNotNull()
    return both.select(
        "hash",
        F.coalesce("name", "new_name").alias("name"),
        (F.coalesce("appearance_count", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("bigint").alias("appearance_count"),
        F.coalesce("created_at", F.lit(now)).alias("created_at"),
        (F.coalesce("is_deleted", F.lit(False)) & ~seen).alias("is_deleted"),
        F.when(~seen, F.col("deleted_at")).alias("deleted_at"),
    )


def insert_relations(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming(subject, predicate, object, confidence, ord, ...); the first row of a canonical triple wins."""
    keyed = incoming.withColumn("hash", tx.relation_hash(F.col("subject"), F.col("predicate"), F.col("object")))
    blank = F.lit(False)
    for c in ("subject", "predicate", "object"):
        blank = blank | (tx.canonical(F.col(c)) == "")
    new = first_by(keyed.where(~blank), ["hash"], F.col("ord"), F.col("subject"), F.col("predicate"), F.col("object"))
    return existing.unionByName(align(new.join(existing.select("hash"), "hash", "left_anti"), existing))


def link(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Idempotent bridge rows."""
    return existing.unionByName(incoming.select(*existing.columns)).distinct()


def link_mentions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Bridge rows whose mention counts add up."""
    keys = ["paragraph_hash", "entity_hash"]
    return existing.unionByName(incoming.select(*existing.columns)).groupBy(*keys).agg(F.sum("mention_count").cast("int").alias("mention_count"))


def patch(df: DataFrame, changes: DataFrame, on: str = "hash") -> DataFrame:
    """Overwrites with what the changes give, row by row; null changes nothing. Of several changes of a key one counts, the same in every run."""
    cols = [c for c in changes.columns if c != on]
    one = first_by(changes, [on], F.xxhash64(*cols))
    joined = df.join(one.select(on, *[F.col(c).alias(f"_{c}") for c in cols]), on, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in cols}).select(*df.columns)


def resolve_entities(entities: DataFrame, specs: DataFrame) -> DataFrame:
    """specs(spec) to hashes: by hash, else exact name, else canonical name."""
    s = specs.select("spec", tx.entity_hash(F.col("spec")).alias("by_name"))
    e = entities.select("hash", "name")
    hits = (
        s.join(e, s.spec == e.hash).select("spec", "hash", F.lit(0).alias("rank"))
        .unionByName(s.join(e, s.spec == e.name).select("spec", "hash", F.lit(1).alias("rank")))
        .unionByName(s.join(e, s.by_name == e.hash).select("spec", "hash", F.lit(2).alias("rank")))
    )
    return first_by(hits, ["spec"], F.col("rank"), F.col("hash")).select("spec", "hash")


def delete_entities(store: dict[str, DataFrame], hashes: DataFrame) -> dict[str, DataFrame]:
    """Entities, their bridge rows, and relations whose subject or object is exactly the name, with their bridge rows."""
    names = store["entity"].join(hashes.select("hash"), "hash", "left_semi").select("name")
    rel = store["relation"]
    gone = rel.join(names.select(F.col("name").alias("subject")), "subject", "left_semi").select("hash").union(rel.join(names.select(F.col("name").alias("object")), "object", "left_semi").select("hash")).distinct()
    return store | delete_relations(store, gone) | {
        "entity": store["entity"].join(hashes.select("hash"), "hash", "left_anti"),
        "paragraph_entity": store["paragraph_entity"].join(hashes.select(F.col("hash").alias("entity_hash")), "entity_hash", "left_anti"),
    }


def delete_relations(store: dict[str, DataFrame], hashes: DataFrame) -> dict[str, DataFrame]:
    """Relations and their bridge rows."""
    keys = hashes.select("hash")
    return store | {
        "relation": store["relation"].join(keys, "hash", "left_anti"),
        "paragraph_relation": store["paragraph_relation"].join(keys.withColumnRenamed("hash", "relation_hash"), "relation_hash", "left_anti"),
    }


def delete_paragraphs(store: dict[str, DataFrame], hashes: DataFrame) -> dict[str, DataFrame]:
    """Paragraphs and their bridge rows."""
    keys = hashes.select(F.col("hash").alias("paragraph_hash"))
    return store | {
        "paragraph": store["paragraph"].join(hashes.select("hash"), "hash", "left_anti"),
        "paragraph_relation": store["paragraph_relation"].join(keys, "paragraph_hash", "left_anti"),
        "paragraph_entity": store["paragraph_entity"].join(keys, "paragraph_hash", "left_anti"),
    }


def delete_paragraphs_deep(store: dict[str, DataFrame], hashes: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Also relations that no other paragraph supports. Returns the store and what else must go: vectors, prune, edges.

    What goes is written once: relations, links and edges are read again for what they keep, not to find it out again.
    Only relations of a pair that loses one are looked at for whether the pair stays.
    """
    hashes = cut(hashes.select("hash").distinct())
    keys = hashes.select(F.col("hash").alias("paragraph_hash"))
    bridge = store["paragraph_relation"]
    touched = cut(bridge.join(keys, "paragraph_hash", "left_semi").select("relation_hash").distinct())
    # Links of other relations tell nothing; a bridge row is shuffled once if it is at a relation that loses one.
    supported = bridge.join(touched, "relation_hash", "left_semi").join(keys, "paragraph_hash", "left_anti").select("relation_hash").distinct()
    orphan = cut(touched.join(supported, "relation_hash", "left_anti").select(F.col("relation_hash").alias("hash")))
    rel = store["relation"].select("hash", tx.canonical(F.col("subject")).alias("s"), tx.canonical(F.col("object")).alias("o"))
    gone = cut(rel.join(orphan, "hash", "left_semi"))
    rest = rel.join(gone.select("s", "o").distinct(), ["s", "o"], "left_semi").join(orphan, "hash", "left_anti").select("s", "o").distinct()
    out = delete_relations(delete_paragraphs(store, hashes), orphan)
    return out, {
        "vectors": hashes.select("hash").union(orphan.select("hash")).distinct(),
        "prune": gone.select(F.col("s").alias("src"), F.col("o").alias("dst"), "hash"),
        "edges": cut(gone.select("s", "o").distinct().join(rest, ["s", "o"], "left_anti").select(F.col("s").alias("src"), F.col("o").alias("dst"))),
    }


def with_deletions(store: dict[str, DataFrame], also: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The store without the vectors, edge hashes and edges that delete_paragraphs_deep says must also go."""
    edge = graph.delete_edges(graph.prune_hashes(store["edge"], also["prune"]), also["edges"])
    return store | {"vector": store["vector"].join(also["vectors"], "hash", "left_anti"), "edge": edge.select(*store["edge"].columns)}


def recycle(store: dict[str, DataFrame], hashes: DataFrame, now: float) -> dict[str, DataFrame]:
    """Relations go to the bin with a time of deletion; their bridge rows stay, so that a restored one has its support."""
    rel = store["relation"]
    binned = align(rel.join(hashes.select("hash"), "hash", "left_semi").withColumn("deleted_at", F.lit(now)), store["deleted_relation"])
    kept = store["deleted_relation"].join(binned.select("hash"), "hash", "left_anti")
    return store | {"relation": rel.join(hashes.select("hash"), "hash", "left_anti"), "deleted_relation": kept.unionByName(binned)}


def restore(store: dict[str, DataFrame], hashes: DataFrame) -> dict[str, DataFrame]:
    """The reverse of recycle; a row of the same hash is replaced."""
    back = store["deleted_relation"].join(hashes.select("hash"), "hash", "left_semi")
    rel = store["relation"].join(back.select("hash"), "hash", "left_anti")
    return store | {"relation": rel.unionByName(align(back, store["relation"])), "deleted_relation": store["deleted_relation"].join(hashes.select("hash"), "hash", "left_anti")}


def mark_deleted(df: DataFrame, hashes: DataFrame, now: float) -> DataFrame:
    """D12"""
    return update(df, hashes.select("hash").distinct(), "hash", is_deleted=F.lit(True), deleted_at=F.lit(now))


def revive(df: DataFrame, hashes: DataFrame) -> DataFrame:
    """D12, X04"""
    return update(df, hashes.select("hash").distinct(), "hash", is_deleted=F.lit(False), deleted_at=F.lit(None).cast("double"))


def delete_rows(df: DataFrame, hashes: DataFrame) -> DataFrame:
    """D13"""
    return df.join(hashes.select("hash"), "hash", "left_anti")


def clear(store: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table without rows."""
    return {name: df.limit(0) for name, df in store.items()}


def set_permanence(df: DataFrame, hashes: DataFrame, permanent: bool) -> DataFrame:
    """D15"""
    return update(df, hashes.select("hash").distinct(), "hash", is_permanent=F.lit(permanent))


def record_access(df: DataFrame, hits: DataFrame) -> DataFrame:
    """hits(hash, at): adds to the count, keeps the latest time."""
    h = hits.groupBy("hash").agg(F.count(F.lit(1)).alias("_more"), F.max("at").alias("_at"))
    return update(df, h, "hash", access_count=F.coalesce("access_count", F.lit(0)) + F.col("_more"), last_accessed=F.greatest("last_accessed", "_at"))


def set_vector_state(relations: DataFrame, changes: DataFrame, now: float) -> DataFrame:
    """changes(hash, state, error, bump). Unknown states change nothing; the error stays only for failed. Of several changes of a hash the last state in order of VECTOR_STATES counts."""
    known = changes.where(F.col("state").isin(*VECTOR_STATES))
    order = F.array_position(F.array(*[F.lit(s) for s in VECTOR_STATES]), F.col("state"))
    c = first_by(known, ["hash"], F.desc(order), F.desc("bump"), F.col("error")).select("hash", F.col("state").alias("_s"), F.col("error").alias("_e"), F.col("bump").alias("_b"))
    return update(
        relations, c, "hash", vector_state=F.col("_s"), vector_updated_at=F.lit(now), vector_error=F.when(F.col("_s") == "failed", F.substring("_e", 1, 500)),
        vector_retry_count=(F.coalesce("vector_retry_count", F.lit(0)) + F.when(F.col("_b"), 1).otherwise(0)).cast("int"),
    )


def relation_text(s: Column, p: Column, o: Column) -> Column:
    """What is embedded of a relation."""
    return F.concat_ws(" ", tx.strip(s), tx.strip(p), tx.strip(o))


def add_missing_vectors(relations: DataFrame, vectors: DataFrame, embed, now: float) -> tuple[DataFrame, DataFrame]:
    """(relations, vectors): embeds relations without a vector. embed: Column of texts to Column of arrays, null on failure."""
    todo = relations.join(vectors.where("item_type = 'relation'").select("hash"), "hash", "left_anti")
    made = todo.select("hash", F.lit("relation").alias("item_type"), embed(relation_text(F.col("subject"), F.col("predicate"), F.col("object"))).alias("embedding"))
    states = made.select("hash", F.when(F.col("embedding").isNotNull(), "ready").otherwise("failed").alias("state"), F.when(F.col("embedding").isNull(), "embedding failed").alias("error"), F.col("embedding").isNull().alias("bump"))
    return set_vector_state(relations, states, now), vectors.unionByName(made.where("embedding is not null").select(*vectors.columns))


def backfill_times(paragraphs: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows without any event time take created_at, at day grain with confidence 0.2; the newest `limit` of them."""
    bare = F.col("event_time").isNull() & F.col("event_time_start").isNull() & F.col("event_time_end").isNull() & F.col("created_at").isNotNull()
    if limit is not None:
        chosen = paragraphs.where(bare).orderBy(F.desc("created_at"), "hash").limit(limit).select("hash")
        return update(paragraphs, chosen, "hash", event_time=F.col("created_at"), time_granularity=F.lit("day"), time_confidence=F.lit(0.2))
    return paragraphs.withColumns({"event_time": F.when(bare, F.col("created_at")).otherwise(F.col("event_time")), "time_granularity": F.when(bare, "day").otherwise(F.col("time_granularity")), "time_confidence": F.when(bare, 0.2).otherwise(F.col("time_confidence"))})


def invalid_types(paragraphs: DataFrame) -> DataFrame:
    """Distinct stored types that are none."""
    return paragraphs.where(~F.coalesce(F.col("knowledge_type").isin(*KNOWLEDGE_TYPES), F.lit(False))).select("knowledge_type").distinct()


def repair_types(paragraphs: DataFrame) -> DataFrame:
    """Invalid types are resolved as legacy names, by content, or as mixed."""
    ok = F.coalesce(F.col("knowledge_type").isin(*KNOWLEDGE_TYPES), F.lit(False))
    return paragraphs.withColumn("knowledge_type", F.when(ok, F.col("knowledge_type")).otherwise(tx.stored_type(F.col("knowledge_type"), F.col("content"), legacy=True, fallback="mixed")))


def hash_aliases(relations: DataFrame, length: int = 32) -> tuple[DataFrame, DataFrame]:
    """(alias, hash) of unique prefixes, and prefixes that several hashes share."""
    g = relations.select(F.substring("hash", 1, length).alias("alias"), "hash").groupBy("alias").agg(F.min("hash").alias("hash"), F.count_distinct("hash").alias("n"))
    return g.where("n = 1").select("alias", "hash"), g.where("n > 1").select("alias", "n")


def resolve_alias(values: DataFrame, relations: DataFrame, aliases: DataFrame) -> DataFrame:
    """values(value) to hashes: a full hash that exists, or a known alias; else an empty string."""
    v = values.select("value", F.lower(F.trim("value")).alias("v"))
    full = v.join(relations.select(F.col("hash").alias("v"), F.col("hash").alias("full")), "v", "left")
    both = full.join(aliases.select(F.col("alias").alias("v"), F.col("hash").alias("short")), "v", "left")
    return both.select("value", F.coalesce(F.when(F.length("v") == 64, F.col("full")).when(F.length("v") == 32, F.col("short")), F.lit("")).alias("hash"))


def delete_by_content(store: dict[str, DataFrame], spec: Column) -> tuple[dict[str, DataFrame], int]:
    """Deletes the paragraph whose hash or normalised content is given; refuses unless exactly one matches. Returns the matches."""
    p = store["paragraph"]
    found = p.where((F.col("hash") == spec) | (F.col("content") == tx.normalize(spec))).select("hash").limit(2)
    n = found.count()
    return (with_deletions(*delete_paragraphs_deep(store, found)) if n == 1 else store), n


def delete_source(store: dict[str, DataFrame], source: str) -> dict[str, DataFrame]:
    """All paragraphs of a source, with their vectors and what only they support in the graph, then entities that no bridge row, relation or out-edge refers to any more."""
    gone = cut(store["paragraph"].where(F.col("source") == source).select("hash"))
    candidates = store["paragraph_entity"].join(gone.select(F.col("hash").alias("paragraph_hash")), "paragraph_hash", "left_semi").select("entity_hash").distinct()
    out = with_deletions(*delete_paragraphs_deep(store, gone))
    used = out["paragraph_entity"].select("entity_hash").distinct()
    names = out["relation"].select(tx.entity_hash(F.col("subject")).alias("entity_hash")).union(out["relation"].select(tx.entity_hash(F.col("object")))).distinct()
    ends = out["edge"].where(graph.ACTIVE).select(F.sha2("src", 256).alias("entity_hash")).distinct()
    orphan = candidates.join(used, "entity_hash", "left_anti").join(names, "entity_hash", "left_anti").join(ends, "entity_hash", "left_anti")
    gone_entities = orphan.withColumnRenamed("entity_hash", "hash")
    return out | {"entity": out["entity"].join(gone_entities, "hash", "left_anti"), "vector": out["vector"].join(gone_entities, "hash", "left_anti")}


def rename_node(edges: DataFrame, old: str, new: str) -> DataFrame:
    """Active edges move to the new name, where weights of one pair add up; inactive edges of the old name go."""
    a, b = tx.canonical(F.lit(old)), tx.canonical(F.lit(new))
    at = (F.col("src") == a) | (F.col("dst") == a)
    moved = edges.where(~at | (F.col("weight") > 0)).withColumns({"src": F.when(F.col("src") == a, b).otherwise(F.col("src")), "dst": F.when(F.col("dst") == a, b).otherwise(F.col("dst"))})
    return moved.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("relation_hashes")))).alias("relation_hashes"))


def set_edge(edges: DataFrame, src: str, dst: str, weight: float | None) -> DataFrame:
    """Creates, sets, or (weight None) removes an edge."""
    a, b = tx.canonical(F.lit(src)), tx.canonical(F.lit(dst))
    same = (F.col("src") == a) & (F.col("dst") == b)
    rest = edges.where(~same)
    if weight is None:
        return rest
    one = edges.sparkSession.range(1).select(a.alias("src"), b.alias("dst"))
    hashes = edges.where(same).groupBy("src", "dst").agg(F.first("relation_hashes").alias("relation_hashes"))
    return rest.unionByName(one.join(hashes, ["src", "dst"], "left").select("src", "dst", F.lit(float(weight)).alias("weight"), F.coalesce("relation_hashes", F.array().cast("array<string>")).alias("relation_hashes")))


def upsert_episodes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replaces by id; the time of creation stays."""
    old = existing.select("episode_id", F.col("created_at").alias("_c"))
    new = align(incoming.join(old, "episode_id", "left").withColumn("created_at", F.coalesce("_c", "created_at")), existing)
    return existing.join(new.select("episode_id"), "episode_id", "left_anti").unionByName(new)


def bind_episode_paragraphs(bridge: DataFrame, bound: DataFrame) -> DataFrame:
    """bound(episode_id, paragraph_hashes): ordered evidence, which replaces what the episode had."""
    rows = bound.select("episode_id", F.posexplode(F.array_distinct("paragraph_hashes")).alias("position", "paragraph_hash"))
    return bridge.join(bound.select("episode_id"), "episode_id", "left_anti").unionByName(align(rows, bridge))


def replace_episodes(existing: DataFrame, bridge: DataFrame, source: str, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All episodes of a source at once; items without title, summary or evidence are left out."""
    good = incoming.where((tx.strip(F.col("title")) != "") & (tx.strip(F.col("summary")) != "") & (F.size("evidence_ids") > 0)).withColumn("source", F.lit(source))
    mine = existing.where(F.col("source") == source)
    new = upsert_episodes(mine, good).join(good.select("episode_id"), "episode_id", "left_semi")
    rest = existing.where(F.coalesce(F.col("source") != source, F.lit(True))).join(new.select("episode_id"), "episode_id", "left_anti")
    links = bridge.join(mine.select("episode_id"), "episode_id", "left_anti")
    return rest.unionByName(new), bind_episode_paragraphs(links, new.select("episode_id", F.col("evidence_ids").alias("paragraph_hashes")))


def last_write(existing: DataFrame, incoming: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key."""
    both = existing.withColumn("_o", F.lit(0)).unionByName(align(incoming, existing).withColumn("_o", F.lit(1)))
    return first_by(both, keys, F.desc(at), F.desc("_o")).drop("_o")


def append_snapshots(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Profile versions count on from the largest of each person."""
    top = existing.groupBy("person_id").agg(F.max("profile_version").alias("_v"))
    w = Window.partitionBy("person_id").orderBy("updated_at", "profile_text")
    new = incoming.join(top, "person_id", "left").withColumn("profile_version", (F.coalesce("_v", F.lit(0)) + F.row_number().over(w)).cast("int"))
    return existing.unionByName(align(new, existing))


def set_overrides(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The newest text of each person; an empty text deletes."""
    return last_write(existing, incoming, ["person_id"], "updated_at").where(tx.strip(F.col("override_text")) != "")
