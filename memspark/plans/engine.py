"""Retrieval plans for a batch of queries; results that a plan reads twice are written while it is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.time import effective_end, effective_start, overlaps
from ..operators import aggregate, catalog, dml, episode, fusion, graph, intervals, joins, knn, profile, sparse, threshold
from ..operators.catalog import LIVE
from ..sources.snapshot import cut, settle
from ..sources.text_index import TextIndex


def parse_relation_query(c: Column) -> Column:
    """struct(structured, subject, predicate, object, error) of s|p|o, s->p->o, s->o, or three words that are no question."""
    # Fixed value: what reads like a question.
    natural = r"(?i)(^\s*(what|who|which|how|why|when|where)\b|\?|？|\b(relation|related|between)\b|(什么关系|有哪些关系|之间|关联))"
    t = F.trim(F.coalesce(c, F.lit("")))
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    pipe = F.split(t, r"\|")
    arrow = F.filter(F.transform(F.split(t, "->"), F.trim), lambda x: x != "")
    word = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    get = lambda xs, i: F.get(xs, F.lit(i))
    row = lambda ok, s, p, o, e: F.struct(F.lit(ok).alias("structured"), s.alias("subject"), p.alias("predicate"), o.alias("object"), F.lit(e).cast("string").alias("error"))
    none = F.lit(None).cast("string")
    arrows = F.when(F.size(arrow) >= 3, row(True, get(arrow, 0), get(arrow, 1), get(arrow, 2), None)).when(F.size(arrow) == 2, row(True, get(arrow, 0), none, get(arrow, 1), None)).otherwise(row(True, none, none, none, "invalid_arrow_format"))
    return F.when(t == "", row(False, none, none, none, "empty")).when(t.contains("|"), row(True, blank(get(pipe, 0)), blank(get(pipe, 1)), blank(get(pipe, 2)), None)).when(t.contains("->"), arrows).when(~t.rlike(natural) & (F.size(word) == 3), row(True, get(word, 0), get(word, 1), get(word, 2), None)).otherwise(row(False, none, none, none, None))


class Engine:
    """Answers batches of queries(query_id, text, embedding) over a store of tables.

    With `paragraph_index` and `relation_index` (postings of paragraphs and of relations, or a TextIndex) sparse recall reads
    no text.
    """

    def __init__(self, store: dict[str, DataFrame], config: Config = Config(), watch: bool = False):
        self.store, self.config, self.watch = store, config, watch
        self.observed: list[tuple[str, Observation]] = []
        for df in store.values():
            settle(df.sparkSession)
            break

    def _seen(self, stage: str, df: DataFrame) -> DataFrame:
        """Counts the rows that pass, in the plan's own run; nothing runs twice."""
        if not self.watch:
            return df
        o = Observation()
        self.observed.append((stage, o))
        return df.observe(o, F.count(F.lit(1)).alias("rows"))

    def metrics(self) -> DataFrame:
        """(stage, rows) of the searches of this engine since the last call; the caller has read their results before."""
        told = [(n, stage, o.get["rows"]) for n, (stage, o) in enumerate(self.observed)]
        self.observed = []
        return self.store["paragraph"].sparkSession.createDataFrame(told, "at int, stage string, rows bigint")

    def _live(self, person: str | None = None) -> DataFrame:
        live = self.store["paragraph"].where(LIVE)
        return live if person is None else catalog.of_person(live, self.store["paragraph_entity"], self.store["entity"], person)

    def _limits(self, queries: DataFrame, lower: float | None = None, upper: float | None = None, source: str | None = None, person: str | None = None) -> tuple[DataFrame, DataFrame | None]:
        """Queries with their own lower, upper, source and person, and the (query_id, hash) that queries with a person may see; None without any."""
        q = intervals.with_limits(queries, lower, upper, source, person)
        if "person" not in queries.columns and person is None or q.where("person is not null").isEmpty():
            return q, None
        return q, cut(intervals.persons_paragraphs(q, self.store["paragraph_entity"], self.store["entity"]))

    def _sparse(self, docs: DataFrame, queries: DataFrame, k: int, postings: str, keep: sparse.Keep = None, among: DataFrame | None = None) -> DataFrame:
        """The k best by BM25; queries without any hit take what n-grams, and after these substrings, find. keep: filters (query_id, hash, ...); among: the same filter for BM25 in blocks, but for queries with a person."""
        c = self.config.sparse
        index = self.store.get(postings) if c.tokenizer == "word" else None
        if isinstance(index, TextIndex):
            hits = index.search(queries, k, c.k1, c.b, keep)
        else:
            more = (k, c.k1, c.b, c.tokenizer, c.ngram)
            own = queries.where("person is not null") if among is not None and "person" in queries.columns else queries.limit(0)
            free = queries.where("person is null") if "person" in queries.columns else queries
            hits = sparse.bm25(docs, free if among is not None else queries, *more, index=index, keep=None if among is not None else keep, among=among)
            if not own.isEmpty():  # a person's paragraphs are pairs of their own
                hits = hits.unionByName(sparse.bm25(docs, own, *more, index=index, keep=keep))
        hits = cut(hits.select("query_id", "hash", "score"))
        limits = [x for x in ("lower", "upper", "source", "person") if x in queries.columns]
        for fallback in (sparse.ngram_search, sparse.substring_search):
            missing = cut(queries.select("query_id", "text", *limits).where("trim(coalesce(text, '')) != ''").join(hits.select("query_id").distinct(), "query_id", "left_anti"))
            if missing.isEmpty():
                return hits
            if among is None or fallback is sparse.substring_search:
                found = fallback(docs, missing, keep=keep)
            else:
                found = fallback(docs, missing.where("person is null") if "person" in limits else missing, among=among)
                own = missing.where("person is not null") if "person" in limits else missing.limit(0)
                if not own.isEmpty():
                    found = found.unionByName(fallback(docs, own, keep=keep))
            hits = cut(sparse.with_fallback(hits, found.select("query_id", "hash", "score"), missing))
        return hits

    def _in_time(self, hits: DataFrame, lower: float | None, upper: float | None, source: str | None = None) -> DataFrame:
        """Hits whose paragraph meets the window, with its interval."""
        p = self._live() if source is None else self._live().where(F.col("source") == source)
        p = p.where(overlaps(effective_start(), effective_end(), lower, upper)).select("hash", effective_start().alias("effective_start"), effective_end().alias("effective_end"))
        return hits.join(p, "hash")

    def paragraphs(self, queries: DataFrame, k: int | None = None, lower: float | None = None, upper: float | None = None, source: str | None = None, person: str | None = None) -> DataFrame:
        """Dense and sparse recall, filtered, gated, fused. Deleted rows, time, source and person are filtered before the best of either are taken.

        queries may have columns lower, upper, source and person of their own, which go before those given for all.
        Queries that ask for a relation always take sparse recall too.
        """
        q, allowed = self._limits(queries, lower, upper, source, person)
        return self._paragraphs(q, allowed, k)

    def _paragraphs(self, q: DataFrame, allowed: DataFrame | None, k: int | None = None) -> DataFrame:
        c = self.config
        k = k or c.top_k_paragraphs
        more = knn.scan_k(k, True, c.temporal_multiplier, c.max_scan)
        live = self._live()
        vectors = self.store["vector"].where("item_type = 'paragraph'")
        found = knn.search_within(vectors, q, live, max(k, more), allowed)
        enough = F.when(intervals.timed(), more).otherwise(k)  # a window's hits are thinned out later
        dense = cut(found.join(q.select("query_id", enough.alias("_k")), "query_id").where(F.col("rank") <= F.col("_k")).select("query_id", "hash", "score"))
        forced = fusion.relation_intent(q).where("force_sparse").select("query_id")
        use = sparse.gate(q, dense, c.sparse.mode, c.sparse.auto_floor).where("use_sparse").select("query_id").union(forced).distinct()
        words = self._sparse(self.store["paragraph"], q.join(use, "query_id", "left_semi"), c.sparse.candidate_k, "paragraph_index", lambda hits: intervals.within(hits, q, live, allowed), intervals.spans(live))
        return fusion.rrf([(dense, c.fusion.vector_weight), (fusion.minmax(words), c.fusion.sparse_weight)], c.fusion.rrf_k)

    def relations(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """Dense and sparse recall of relations, with graph recall for queries that ask for one."""
        c = self.config
        q = fusion.relation_intent(queries, c.top_k_final, c.top_k_relations, c.intent.alpha, c.intent.candidate_multiplier, c.intent.preserve, c.intent.pair_limit)
        k = (k or c.top_k_relations) * c.intent.candidate_multiplier
        active = self.store["relation"].where("not coalesce(is_inactive, false)")
        vectors = self.store["vector"].where("item_type = 'relation'").join(active.select("hash"), "hash", "left_semi")
        dense = knn.search(vectors, queries, k).select("query_id", "hash", "score")
        words = self._sparse(sparse.relation_docs(self.store["relation"]), queries, c.sparse.relation_k, "relation_index", lambda hits: hits.join(active.select("hash"), "hash", "left_semi"), active.select("hash"))
        asked = q.where("relation_intent").select("query_id", "text")
        seeds = graph.seed_entities(asked, self.store["node"])
        found = graph.recall(seeds, self.store["edge"], c.graph.recall_k, c.graph.two_hop_below)
        held = self.store["paragraph_relation"].groupBy(F.col("relation_hash").alias("hash")).agg(F.count(F.lit(1)).alias("support"))
        g = found.join(held, "hash", "left").select("query_id", "hash", "candidate_type", F.coalesce("support", F.lit(0)).alias("support"))
        merged = fusion.merge_graph(dense, words, g).join(active.select("hash"), "hash", "left_semi")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "hash")
        return merged.withColumn("_n", F.row_number().over(w)).join(q.select("query_id", "relation_top_k"), "query_id").where(F.col("_n") <= F.col("relation_top_k")).select("query_id", "hash", "score")

    def search(self, queries: DataFrame, lower: float | None = None, upper: float | None = None, source: str | None = None, ppr: bool = False, threshold_on: bool = True, person: str | None = None, paths_on: bool = True) -> DataFrame:
        """The two paths fused, reranked, cut by the adaptive threshold, without repeated contents.

        queries may have columns lower, upper, source and person of their own, which go before those given for all: one
        plan answers requests with different windows. Queries that ask for a relation see few relations of one pair; weak
        answers get the paths between the two entities they name in front; within a time window equal scores go by the
        latest time.
        """
        c = self.config
        limited_, allowed = self._limits(queries, lower, upper, source, person)
        bounds = cut(limited_.select("query_id", "lower", "upper", "source", "person"))
        timed = bounds.where(intervals.timed()).select("query_id")
        some_timed, some = not timed.isEmpty(), bounds.where(intervals.timed() | F.col("person").isNotNull()).select("query_id")
        q = fusion.relation_intent(queries, c.top_k_final, c.top_k_relations, c.intent.alpha, c.intent.candidate_multiplier, c.intent.preserve, c.intent.pair_limit)
        # Results of each path are few rows a query and are read several times below: written once, not computed again.
        p, r = cut(self._seen("paragraphs", self._paragraphs(limited_, allowed))), cut(self._seen("relations", self.relations(queries)))
        if some_timed or allowed is not None:
            mine = r.join(some, "query_id", "left_semi")
            support = intervals.support_within(mine, bounds, self.store["paragraph_relation"], self._live(), allowed)
            r = r.join(some, "query_id", "left_anti").unionByName(mine.join(support.select("query_id", "hash"), ["query_id", "hash"], "left_semi"))
        alpha = q.select("query_id", F.coalesce("alpha", F.lit(c.alpha)).alias("_a"))
        fused = cut(self._seen("fused", fusion.fuse(p.join(alpha, "query_id"), r.join(alpha, "query_id"), self.store["paragraph_relation"], F.col("_a"), c.intent.preserve)))
        if ppr:
            seeds = graph.seed_entities(queries, self.store["node"]).select("query_id", F.col("canon").alias("node"), F.lit(1.0).alias("weight"))
            rank = graph.pagerank(self.store["edge"], self.store["node"], seeds, c.graph.alpha, c.graph.max_iter, c.graph.tol)
            names = self.store["entity"].select(F.col("hash").alias("entity_hash"), F.lower(F.trim("name")).alias("node"))
            fused = fusion.ppr_rerank(fused, self.store["paragraph_entity"], rank.join(names, "node").select("query_id", "entity_hash", F.col("score").alias("ppr")), c.ppr_weight)
        if threshold_on:
            fused = cut(self._seen("above threshold", threshold.adaptive(fused, c.threshold)))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "result_type", "hash")
        fused = fused.select("query_id", "hash", "score", "result_type").withColumn("rank", F.row_number().over(w))
        limited = q.where("pair_limit > 0").select("query_id")
        asked = fusion.pair_rerank(fused.join(limited, "query_id", "left_semi"), self.store["relation"], c.intent.pair_limit)
        ranked = fused.join(limited, "query_id", "left_anti").unionByName(asked)
        if some_timed:
            mine = ranked.join(timed, "query_id", "left_semi")
            by_text = mine.join(self._live().select("hash", effective_start().alias("effective_start"), effective_end().alias("effective_end")), "hash").select("query_id", "hash", "effective_start", "effective_end")
            by_relation = intervals.support_within(mine.where("result_type = 'relation'"), bounds, self.store["paragraph_relation"], self._live()).select(*by_text.columns)
            sorted_ = fusion.temporal_sort(mine.join(by_text.unionByName(by_relation), ["query_id", "hash"], "left"))
            ranked = ranked.join(timed, "query_id", "left_anti").unionByName(sorted_.select(*ranked.columns))
        ranked = cut(self._seen("ranked", ranked.where(F.col("rank") <= c.top_k_final).select("query_id", "hash", "score", "result_type", "rank")))
        content = self.store["paragraph"].select("hash", "content", "source").unionByName(self.store["relation"].select("hash", F.concat_ws(" ", "subject", "predicate", "object").alias("content"), F.lit("relation").alias("source")))
        found = ranked.join(content, "hash")
        if paths_on:
            walks = self._paths_for(queries, ranked)
            if walks is not None:
                first = fusion.with_paths(ranked, walks, c.path_below).where(F.col("rank") <= c.top_k_final)
                texts = walks.select("query_id", "hash", "content", F.lit("path").alias("source"))
                found = first.where("result_type != 'path'").join(content, "hash").unionByName(first.where("result_type = 'path'").join(texts, ["query_id", "hash"]))
        return self._seen("deduplicated", fusion.content_dedup(found, c.top_k_final))

    def _paths_for(self, queries: DataFrame, ranked: DataFrame) -> DataFrame | None:
        """(query_id, hash, content) of the paths between the entities of queries with weak results that name just two; None if there is none."""
        c = self.config
        best = ranked.groupBy("query_id").agg(F.max("score").alias("best"))
        weak = queries.select("query_id", "text").join(best, "query_id", "left").where(F.coalesce(F.col("best") < c.path_below, F.lit(True))).select("query_id", "text")
        seeds = graph.seed_entities(weak, self.store["node"], 3).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "canon"))).alias("x"))
        pairs = cut(seeds.where(F.size("x") == 2).select("query_id", F.col("x")[0]["canon"].alias("a"), F.col("x")[1]["canon"].alias("b")))
        if pairs.isEmpty():
            return None
        walks = graph.paths(self.store["edge"], pairs, c.graph.max_depth, c.graph.max_paths)
        text = F.array_join("nodes", " -> ")
        return cut(walks.select("query_id", F.concat(F.lit("path-"), F.sha2(text, 256)).alias("hash"), text.alias("content")))

    def in_time(self, queries: DataFrame, lower: float | None = None, upper: float | None = None, source: str | None = None, k: int | None = None, person: str | None = None) -> DataFrame:
        """By time alone: the newest paragraphs of each query's window, source and person.

        Windows take their places in lists of the paragraphs by time. Queries without a bound share lists: the newest of all,
        or of a source. Contents come to the rows that are found.
        """
        q, allowed = self._limits(queries, lower, upper, source, person)
        q, k = q.select("query_id", "lower", "upper", "source", "person"), k or self.config.top_k_final
        p = self._live().select("hash", F.col("source").alias("_source"), effective_start().alias("start"), effective_end().alias("end"), "updated_at")
        newest = [F.desc("end"), F.desc("updated_at"), F.col("hash")]
        first = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*newest))).where(F.col("_n") <= k)
        mine, open_ = q.where("person is null").where(intervals.timed()), q.where("person is null").where(~intervals.timed())
        out = [intervals.newest(mine, p, k)]
        cols = ["query_id", *p.columns]
        out.append(open_.where("source is null").select("query_id").crossJoin(F.broadcast(p.orderBy(*newest).limit(k))))  # k rows
        asked = open_.where("source is not null").select("query_id", F.col("source").alias("_source"))
        out.append(asked.join(first(p.join(asked.select("_source").distinct(), "_source", "left_semi"), "_source"), "_source"))
        if allowed is not None:
            named = allowed.join(p, "hash").join(q.where("person is not null"), "query_id").where(intervals.meets(F.col("start"), F.col("end")) & F.expr("source is null or source = _source"))
            out.append(first(named, "query_id"))
        every = out[0].select(*cols)
        for df in out[1:]:
            every = every.unionByName(df.select(*cols))
        every = every.join(self.store["paragraph"].select("hash", "content"), "hash").select("query_id", "hash", "content", *cols[2:])
        every = every.withColumnsRenamed({"start": "effective_start", "end": "effective_end"}).drop("_source").withColumn("score", F.lit(1.0))
        return fusion.temporal_sort(every)

    def episodes(self, queries: DataFrame, lower: float | None = None, upper: float | None = None, source: str | None = None, k: int = 5, person: str | None = None) -> DataFrame:
        """Visible episodes by their words and by the evidence that search finds. person: those that name the person, or whose paragraphs do."""
        e = joins.visible_episodes(self.store["episode"], self.store["rebuild_source"], lower, upper, source, person, self.store["episode_paragraph"], self.store["paragraph_entity"], self.store["entity"])
        hits = self.search(queries, threshold_on=False, paths_on=False).select("query_id", "hash", "rank", "result_type")
        p, r = hits.where("result_type = 'paragraph'"), hits.where("result_type = 'relation'")
        by_p = joins.episodes_of_paragraphs(p, self.store["episode_paragraph"], e)
        by_r = joins.episodes_of_relations(r, self.store["paragraph_relation"], self.store["episode_paragraph"], e)
        words = episode.lexical(e, queries, max(30, 6 * k)).select("query_id", F.col("episode_id").alias("hash"), "score")
        branches = [(words, 1.0), (episode.evidence_rank(by_p, p, "matched_paragraphs"), 1.0), (episode.evidence_rank(by_r, r, "matched_relations"), 0.85)]
        return episode.fuse(branches, e, k, self.config.aggregate_k)

    def aggregate(self, queries: DataFrame, lower: float | None = None, upper: float | None = None, weights: dict[str, float] | None = None, k: int = 5) -> DataFrame:
        """Search, time (with a bound) and episode branches mixed."""
        branches = {"search": self.search(queries).select("query_id", "hash", "result_type", "rank")}
        if lower is not None or upper is not None:
            branches["time"] = self.in_time(queries, lower, upper).select("query_id", "hash", F.lit("paragraph").alias("result_type"), "rank")
        branches["episode"] = self.episodes(queries, lower, upper).select("query_id", F.col("episode_id").alias("hash"), F.lit("episode").alias("result_type"), "rank")
        return aggregate.mix(branches, weights, k, self.config.aggregate_k)

    def relation_query(self, queries: DataFrame, minimum: float = 0.4) -> DataFrame:
        """Exact lookup of structured queries, else search among relations; weak answers gain by path evidence."""
        q = queries.withColumn("spec", parse_relation_query(F.col("text")))
        rel = self.store["relation"]
        same = lambda c: F.col(f"spec.{c}").isNull() | (F.lower(c) == F.lower(f"spec.{c}"))
        s = q.where("spec.structured and spec.subject is not null").withColumn("_s", F.lower("spec.subject"))
        exact = s.join(rel.withColumn("_s", F.lower("subject")), "_s").where(same("predicate") & same("object")).select("query_id", "hash", F.lit(1.0).alias("score"))
        rest = cut(queries.join(exact.select("query_id").distinct(), "query_id", "left_anti"))
        if rest.isEmpty():  # no search for no query
            return exact
        found = self.relations(rest)
        seeds = graph.seed_entities(rest, self.store["node"]).groupBy("query_id").agg(F.array_sort(F.collect_list("canon")).alias("x")).where(F.size("x") == 2)
        walks = graph.paths(self.store["edge"], seeds.select("query_id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b")), self.config.graph.max_depth, self.config.graph.max_paths)
        weak = found.groupBy("query_id").agg(F.max("score").alias("best")).where(F.col("best") < minimum).select("query_id")
        better = fusion.path_bonus(found.join(weak, "query_id", "left_semi"), rel, graph.path_edges(walks))
        return exact.unionByName(better.select("query_id", "hash", "score")).unionByName(found.join(weak, "query_id", "left_anti"))

    def query(self, mode: str, queries: DataFrame, **options) -> DataFrame:
        """By mode: search, time, episode, aggregate, relation, entity, person."""
        return {"search": self.search, "time": self.in_time, "episode": self.episodes, "aggregate": self.aggregate, "relation": self.relation_query, "entity": self.entities, "person": self.persons}[mode](queries, **options)

    def entities(self, queries: DataFrame) -> DataFrame:
        """The entity that a query's text names, by hash, exact or canonical name, with its neighbours and paragraphs."""
        known = dml.resolve_entities(self.store["entity"], queries.select(F.col("text").alias("spec")).distinct())
        asked = self.store["entity"].join(known.select("hash").distinct(), "hash", "left_semi")
        cards = catalog.entity_cards(asked, self.store["edge"], self.store["paragraph_entity"])
        return queries.select("query_id", F.col("text").alias("spec")).join(known, "spec").join(cards, "hash").select("query_id", "hash", "name", "neighbors", "paragraphs")

    def persons(self, queries: DataFrame, persons: DataFrame, now: float) -> DataFrame:
        """The person that a query's text names, by id, name or nickname, with the latest profile, a manual one first, and whether it is out of date."""
        found = profile.resolve(persons, queries.select(F.col("text").alias("key")).distinct())
        snapshots = self.store["profile_snapshot"]
        latest = profile.with_override(profile.latest(snapshots), self.store["profile_override"])
        old = profile.stale(snapshots, now).select("person_id", F.lit(True).alias("stale"))
        rows = queries.select("query_id", F.col("text").alias("key")).join(found, "key").join(latest, "person_id", "left").join(old, "person_id", "left")
        return rows.select("query_id", "person_id", "profile_text", F.coalesce("overridden", F.lit(False)).alias("overridden"), F.coalesce("stale", F.lit(True)).alias("stale"))
