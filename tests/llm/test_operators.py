"""Fingerprints, toxicity, mixing, packing, quality, extraction and the pipeline on small tables."""

import glob
import html
import math
import os
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from memspark.llm.fingerprints import fingerprint, fingerprints
from memspark.llm.html_extract import extract
from memspark.llm.common import Work, mix64
from memspark.llm.mixing import CLASSES, DIMS, fit_topics, mix, sample
from memspark.llm.packing import pack_documents
from memspark.llm.quality import quality, resample, top
from memspark.llm.queries import oracle_sql, queries
from memspark.llm.shingles import words as hash_words
from memspark.llm.toxicity import toxicity
from pyspark.sql import functions as F

from . import helpers as h


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_fingerprints(spark):
    docs = h.edge_docs(spark)
    got = fingerprints(docs).collect()
    assert len(got) == docs.count()
    ordered = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    texts = [t for _, _, t in ordered]
    by = {(r.doc_id, r.n_chars, r.edited_text): r for r in got}
    prints = {}
    for k, (some, i, t) in enumerate(ordered):
        nxt = texts[(k + 1) % len(texts)]
        q = len(t) // 4
        r = by[(i if some else None, len(t), t[: len(t) - q] + nxt[:q])]
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint and prints.setdefault(r.edited_text, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        for x, y, got_ in ((t, r.edited_text, r.near_edited), (t, nxt, r.near_next)):
            a, b = h.shingles(x.lower(), 5), h.shingles(y.lower(), 5)
            if not a or not b:
                assert got_ == (1.0 if not a and not b else 0.0)
            else:
                assert abs(got_ - len(a & b) / len(a | b)) < (0.2 if len(a | b) >= 40 else 0.6)  # few shingles fill few bins
    assert fingerprints(h.empty_docs(spark)).count() == 0
    assert fingerprint(docs).where("length(fingerprint) not in (0, 512)").count() == 0


def brute_bins(spark, text):
    """Bins by hand: one hash a shingle, and for an empty bin the first donor of its own order."""
    w = [x for x in re.split("[\\x20\\x09-\\x0D]+", text.lower()) if x]
    if not w:
        return []
    sets = sorted({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else []
    hashed = lambda rows, ddl, *cols: [r[0] for r in spark.createDataFrame(rows, ddl).select(F.xxhash64(*cols)).collect()]
    if sets:
        one = dict(zip(sorted(set(w)), hashed([(x,) for x in sorted(set(w))], "a string", "a"), strict=True))
        values = hashed([[one[x] for x in s] for s in sets], "a long, b long, c long, d long, e long", *"abcde")
    else:
        acc = 42
        for x in hashed([(x,) for x in w], "a string", "a"):
            acc = hashed([(acc, x)], "a long, b long", "a", "b")[0]
        values = [acc]
    own = {}
    for v in values:
        own[(v >> 56) + 128] = min(own.get((v >> 56) + 128, 2**60), v & ((1 << 56) - 1))
    empty = [j for j in range(256) if j not in own]
    place = [(j, r) for j in empty for r in range(1, 9)]
    early = dict(zip(place, hashed(place, "a int, b int", "a", "b"), strict=True)) if place else {}
    pair = [(j, k) for j in empty for k in sorted(own)]
    late = dict(zip(pair, hashed(pair, "a int, b int", "a", "b"), strict=True)) if pair else {}
    full = []
    for j in range(256):
        donor = j if j in own else next((early[j, r] % 256 for r in range(1, 9) if early[j, r] % 256 in own), None)
        full.append(own[min(own, key=lambda k: late[j, k]) if donor is None else donor])
    return [x % 256 - 128 for x in hashed([(x, j) for j, x in enumerate(full)], "a long, b int", "a", "b")]


def test_fingerprint_brute(spark):
    r = random.Random(3)
    texts = ["", " \n", "One", "a b  C d", " ".join(f"w{r.randrange(50)}" for _ in range(40)), " ".join(f"é{r.randrange(10**6)}" for _ in range(700)), "x y z " * 50]
    got = fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for x in got:
        assert x.fingerprint == "".join(f"{b + 128:02X}" for b in brute_bins(spark, x.text))


def test_fingerprint_estimate(spark):
    """Over many pairs the estimate is right on average, and near a share of bins' deviation."""
    r = random.Random(5)
    rows, truth = [], []
    for i in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(300)]
        other = [w if r.random() > 0.05 else "x" + w for w in words]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        a, b = h.shingles(rows[-2][1], 5), h.shingles(rows[-1][1], 5)
        truth.append(len(a & b) / len(a | b))
    got = {x.doc_id: x.near_next for x in fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    error = np.array([got[2 * i] - truth[i] for i in range(60)])
    assert abs(error.mean()) < 0.02 and error.std() < 0.06


def toxic_corpus(n=600, seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ta", "ro", "mi", "ne", "su")) for _ in range(r.randint(1, 4)))
    docs, marks = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(5, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(("Grumble", "wretchedly", "blockhead")))
        docs.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    return docs, marks


def test_toxicity_held_out(spark):
    docs, marks = toxic_corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity(df, labels(spark, marks)).collect()}
    truth = {i: t for i, _, t in marks}
    held = [i for i in got if got[i].held_out]
    assert held and all((zlib.crc32(str(i).encode()) % 5 == 0) == got[i].held_out for i in got)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    # Labels of held-out rows change nothing.
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in marks]
    again = {r.doc_id: r.score for r in toxicity(df, labels(spark, flipped)).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in got)


def test_toxicity_edges(spark):
    docs, marks = toxic_corpus(200)
    odd = h.edge_docs(spark)
    both = odd.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in docs], "doc_id long, text string"), allowMissingColumns=True)
    out = toxicity(both, labels(spark, [(10_000 + i, q, t) for i, q, t in marks] + [(None, 1, 1), (3, None, None)])).collect()
    assert len(out) == both.count()
    same = {}
    for r in out:
        assert same.setdefault(r.text or "", r.score) == pytest.approx(r.score) and isinstance(r.score, float)
    assert toxicity(h.empty_docs(spark), labels(spark, marks)).count() == 0
    assert {r.score for r in toxicity(odd, labels(spark, [])).collect()} == {0.0}


def test_mixing(spark):
    docs = spark.read.parquet(f"{h.SF}/documents.parquet")
    out = mix(docs)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(docs.count()))
    total = sum(r.n_tokens for r in rows)
    assert abs(sum(r.n_tokens * r.probability for r in rows) - 0.8 * total) < 0.001 * total
    for m, alpha in (("source", 0.5), ("lang", 0.7), ("topic", 0.7)):
        have, raked = {}, {}
        for r in rows:
            have[r[m]] = have.get(r[m], 0) + r.n_tokens
            raked[r[m]] = raked.get(r[m], 0) + r.n_tokens * r.weight
        want = {k: v**alpha for k, v in have.items()}
        for k in have:
            assert raked[k] / sum(raked.values()) == pytest.approx(want[k] / sum(want.values()), abs=1e-3)
    again = {r.doc_id: (r.kept, r.probability) for r in mix(docs).collect()}
    assert all(again[r.doc_id][0] == r.kept for r in rows)
    table = {r.doc_id: (r.kept, r.probability) for r in mix(docs, cells_on_driver=0).collect()}
    assert all(table[r.doc_id] == (r.kept, r.probability) for r in rows)
    assert {r.doc_id for r in sample(docs).collect()} == {r.doc_id for r in rows if r.kept}


def test_mixing_brute(spark):
    """Tokens, topics, cells and probabilities against plain Python, over whole texts."""
    docs = spark.read.parquet(f"{h.SF}/documents.parquet")
    data = {r.doc_id: r for r in docs.collect()}
    words_of = {i: re.findall(h.WORD, (r.text or "").encode().lower()) for i, r in data.items()}
    got = {r.doc_id: r for r in mix(docs).collect()}
    hashed = lambda w: int(hash_words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0])
    every = {w: hashed(w) for w in set().union(*words_of.values())}
    df = Counter(c for ws in words_of.values() for w in {every[w] for w in ws} for c in [w % CLASSES])
    weight = {c: max(0.0, math.log((len(data) + 1) / (n + 1))) for c, n in df.items()}

    def vector(ws):
        v = [0.0] * DIMS
        for w in {every[w] for w in ws}:
            s = int(mix64(np.array([w], np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))[0])
            v[s % DIMS] += weight[w % CLASSES] * (1 if s >> 63 else -1)
        length = math.sqrt(sum(x * x for x in v))
        return [round(x / length * 127) if length else 0 for x in v]

    vecs = {i: vector(ws) for i, ws in words_of.items()}
    model = fit_topics(docs.select("doc_id", "text"), Work(spark, "test"))
    like = lambda v: [sum(a * b for a, b in zip(v, c)) for c in model.centres]
    assert sum(int(np.argmax(like(vecs[i]))) == int(got[i].topic) for i in data) >= 0.99 * len(data)
    # Rounds of k-means end where each centre is the direction of its texts' sum, or near it; clusters beat chance.
    own = np.mean([max(like(v)) / (math.sqrt(sum(x * x for x in v)) or 1) for v in vecs.values()])
    other = np.mean([np.mean(like(v)) / (math.sqrt(sum(x * x for x in v)) or 1) for v in vecs.values()])
    assert own > other + 0.1 and len({r.topic for r in got.values()}) > 2
    cells = Counter()
    for i, r in got.items():
        assert r.n_tokens == len(words_of[i]) and r.source == data[i].source and r.lang == data[i].lang
        cells[r.source, r.lang, r.topic] += r.n_tokens
    factor = dict.fromkeys(cells, 1.0)
    for _ in range(400):
        for k, a in enumerate((0.5, 0.7, 0.7)):
            have, now = Counter(), Counter()
            for c, n in cells.items():
                have[c[k]] += n
                now[c[k]] += n * factor[c]
            share = sum(n**a for n in have.values() if n)
            for c in cells:
                if now[c[k]]:
                    factor[c] *= have[c[k]] ** a / share * sum(cells.values()) / now[c[k]]
    low, high = 0.0, 1e6
    for _ in range(200):
        s = (low + high) / 2
        if sum(n * min(1, s * factor[c]) for c, n in cells.items()) < 0.8 * sum(cells.values()):
            low = s
        else:
            high = s
    for r in got.values():
        assert r.probability == pytest.approx(min(1, low * factor[r.source, r.lang, r.topic]), abs=2e-6)


def test_mixing_edges(spark):
    docs = h.edge_docs(spark)
    out = mix(docs, topic_col="topic", targets={"lang": {"en": 1.0}})
    assert out.count() == docs.count()
    assert {r.kept for r in out.where("lang is null and n_tokens > 0").collect()} <= {False}
    assert mix(h.empty_docs(spark)).count() == 0
    assert mix(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 1
    kept = sample(docs)  # the table has columns of other operators' names
    assert kept.columns == docs.columns and kept.count() == mix(docs).where("kept").count()
    assert sample(h.empty_docs(spark)).count() == 0


def check_packing(rows, docs, capacity):
    windows, pieces = {}, {}
    for r in rows:
        windows.setdefault(r.window, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for w in windows.values():
        w.sort(key=lambda r: (r.window_offset, r.n_tokens))
        assert sum(r.n_tokens for r in w) <= capacity
        at = 0
        for r in w:
            assert r.window_offset == at
            at += r.n_tokens
        real = [docs[r.doc_id] for r in w if r.doc_id in docs]
        sources = [d[0] for d in real if d[0] is not None]
        texts = [d[1].lower() for d in real if (d[1] or "").split()]
        assert len(sources) == len(set(sources)) and len(texts) == len(set(texts))
    return pieces


def test_packing(spark):
    docs = spark.read.parquet(f"{h.SF}/documents.parquet")
    for size in (64, 2048):
        rows = pack_documents(docs, capacity=size, shard_pieces=50).collect()
        known = {r.doc_id: (r.source, r.text) for r in docs.collect()}
        pieces = check_packing(rows, known, size)
        for i, (_, text) in known.items():
            p = sorted(pieces[i], key=lambda r: r.piece)
            assert [r.start for r in p] == [k * size for k in range(len(p))] and [r.piece for r in p] == list(range(len(p)))
            assert sum(r.n_tokens for r in p) == len([w for w in text.replace("\x85", "x").split()] if text else [])
    odd = h.edge_docs(spark)
    assert sorted(map(str, (r.doc_id for r in pack_documents(odd).where("piece = 0").collect()))) == sorted(map(str, (r.doc_id for r in odd.collect())))
    place = lambda d: sorted(map(str, pack_documents(d, capacity=64, shard_pieces=50).collect()))
    assert place(docs.repartition(7)) == place(docs.orderBy(F.desc("doc_id")))  # however the rows lie in files
    registered = queries()["op4_best_fit_packing"](spark, h.SF).collect()
    check_packing(registered, known, 2048)
    assert sorted(registered) == sorted(pack_documents(docs).collect())
    assert pack_documents(h.empty_docs(spark)).count() == 0


def test_quality(spark):
    docs = spark.read.parquet(f"{h.SF}/documents.parquet")
    marks = spark.read.parquet(f"{h.SF}/labels.parquet")
    out = quality(docs, marks).collect()
    share = np.mean([r.quality for r in marks.collect()])
    assert len(out) == docs.count() and sum(r.kept for r in out) == math.ceil(share * len(out))
    assert min(r.key for r in out if r.kept) >= max(r.key for r in out if not r.kept)
    truth = {r.doc_id: r.quality for r in marks.collect()}
    good = np.mean([r.kept for r in out if truth.get(r.doc_id) == 1])
    bad = np.mean([r.kept for r in out if truth.get(r.doc_id) == 0])
    assert good > bad + 0.3
    odd = h.edge_docs(spark)
    assert resample(odd, spark.createDataFrame([], "doc_id long"), 0.5).where("kept").count() >= math.ceil(odd.count() / 2)
    assert resample(h.empty_docs(spark), marks.select("doc_id"), 0.5).count() == 0


def test_quality_weights(spark):
    """Log weights against counts of the same n-grams in plain Python."""
    import pyarrow as pa
    from memspark.llm.quality import BUCKETS, ngrams

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{h.SF}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{h.SF}/labels.parquet").where("quality = 1").collect()}
    grams = {i: Counter(ngrams(pa.RecordBatch.from_pydict({"text": pa.array([t])}))[1].tolist()) for i, t in docs.items()}
    assert all(sum(g.values()) == max(0, 2 * len(docs[i].split()) - 1) for i, g in grams.items())
    raw = sum(grams.values(), Counter())
    target = sum((grams[i] for i in good if i in grams), Counter())
    ratio = {b: math.log((target[b] + 1) / (target.total() + BUCKETS)) - math.log((n + 1) / (raw.total() + BUCKETS)) for b, n in raw.items()}
    for r in queries()["op3_quality"](spark, h.SF).collect():
        assert r.log_weight == pytest.approx(sum(n * ratio[b] for b, n in grams[r.doc_id].items()), abs=1e-6)


def test_extract_query(spark):
    """Over the pages table: the text of the article element."""
    want = {}
    for r in spark.read.parquet(f"{h.SF}/pages.parquet").collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        want[r.page_id] = " ".join(html.unescape(re.sub("<[^>]+>", "", re.sub(r"</?(p|br|h1)[^>]*>", " ", inner))).split())
    got = queries()["op1_html_extract"](spark, h.SF).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_gumbel_samples_by_weight(spark):
    """Keys of weight w win the top place with probability w / sum."""
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    keys = resample(rows, spark.createDataFrame([], "doc_id long"), 0.25).collect()
    noise = np.array([r.key for r in keys])
    assert abs(noise.mean() - 0.5772) < 0.02 and abs(noise.std() - math.pi / math.sqrt(6)) < 0.02


def test_top(spark, monkeypatch):
    import memspark.llm.quality as m

    monkeypatch.setattr(m, "LAST", 50)
    r = random.Random(1)
    rows = [(i, r.choice([r.gauss(0, 1), 0.5, -2.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, key double")
    for k in (0, 1, 700, 1500, 2999, 3000):
        got = {x.doc_id for x in df.where(top(df, k)).collect()}
        assert got == {i for i, _ in sorted(rows, key=lambda x: (-x[1], -x[0]))[:k]}


def test_top_by_large_ids(spark, monkeypatch):
    """One key for all rows: whole ids decide, beyond what a double can tell apart."""
    import memspark.llm.quality as m

    monkeypatch.setattr(m, "LAST", 5)
    ids = [2**62 + i for i in range(40)] + list(range(-20, 20))
    df = spark.createDataFrame([(i, 1.0) for i in ids], "doc_id long, key double")
    for k in (1, 7, 39, 41, 79):
        assert {x.doc_id for x in df.where(top(df, k)).collect()} == set(sorted(ids, reverse=True)[:k])


def test_quality_brute(spark):
    """The registered query's whole selection, from plain counts and the noise of each id."""
    rows = queries()["op3_quality"](spark, h.SF).collect()
    noise = {r.id: r.n for r in spark.range(len(rows)).select("id", (-F.log(-F.log((F.shiftrightunsigned(F.xxhash64(F.lit(11), "id"), 12) + F.lit(0.5)) / float(1 << 52)))).alias("n")).collect()}
    marks = [r.quality for r in spark.read.parquet(f"{h.SF}/labels.parquet").collect()]
    best = sorted(rows, key=lambda r: (-(r.log_weight + noise[r.doc_id]), -r.doc_id))[: math.ceil(sum(marks) / len(marks) * len(rows))]
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in best}


def test_toxicity_brute(spark):
    """Features and scores of the registered query against n-grams in plain Python and the fitted weights."""
    from memspark.llm.toxicity import BITS, SIZES, fit

    docs = spark.read.parquet(f"{h.SF}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{h.SF}/labels.parquet"))
    got = {r.doc_id: r for r in queries()["op6_toxicity"](spark, h.SF).collect()}

    def bucket(gram):
        x = ord(gram[0])
        for c in gram[1:]:
            x = (x * 0x01000193 + ord(c)) % 2**32
        return ((x + len(gram)) * 0x9E3779B1) % 2**32 >> (32 - BITS)

    for r in docs.collect():
        t = (r.text or "").lower()
        found = {model.slot[bucket(t[i : i + n])] for n in SIZES for i in range(len(t) - n + 1)} - {-1}
        z = sum(model.weight[f] for f in found) + model.bias
        want = 1 / (1 + math.exp(-z)) if abs(z) < 700 else float(z > 0)
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-9) and got[r.doc_id].predicted == int(want >= 0.5)
    assert len(got) == docs.count()


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Some text &amp; more of it here.</p></article>", "t"), (2, None, None, None), (3, "v", "", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extract(pages).collect()}
    assert got[1].text == "Some text & more of it here." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert extract(pages.limit(0)).count() == 0


def test_pipeline(spark):
    """Each stage against brute force on what the stage before it kept."""
    docs = spark.read.parquet(f"{h.SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], h.SF).cache())
    for t in tables[1:-1]:
        assert sorted(t.columns) == sorted(docs.columns) and dict(t.dtypes) == dict(docs.dtypes)
    data = [{r.doc_id: r for r in t.collect()} for t in tables[:-1]]
    bad = {r.doc_id for r in spark.read.parquet(f"{h.SF}/labels.parquet").where("toxic = 1").collect()}
    assert len(bad - set(data[1])) > len(bad) / 2 and len(set(data[1])) > 0.8 * len(data[0])
    lines = h.brute_lines([(i, r.text) for i, r in data[1].items()])
    assert {i: h.sha(r.text) for i, r in data[2].items()} == {i: x[2] for i, x in lines.items()}
    assert all(r.n_chars == len(r.text) for r in data[2].values())
    near = h.brute_near([(i, r.text) for i, r in data[2].items()], 5)
    assert set(data[3]) == {i for i, (_, c) in near.items() if c == i}
    assert set(data[4]) == {r.doc_id for r in mix(tables[3]).where("kept").collect()}
    packed = tables[5].collect()
    assert {r.doc_id for r in packed} == set(data[4])
    check_packing(packed, {i: (r.source, r.text) for i, r in data[4].items()}, 2048)
    assert corpus_pipeline.run(spark, h.SF).count() == len(packed)


def test_registered():
    assert sorted(queries(), key=lambda x: int(x[2:].split("_")[0])) == list(queries())
    assert set(oracle_sql()) <= set(queries())


def test_pipeline_edges(spark, tmp_path):
    """Nulls in any column, empty and repeated texts, repeated rows; then empty tables."""
    docs = spark.read.parquet(f"{h.SF}/documents.parquet")
    blank = [(None,) * len(docs.columns)] * 2
    texts = [None, "", " \n\t", "one", "a long line that two documents share\nb", "a long line that two documents share\nc", "word " * 5000]
    rows = [tuple({"doc_id": i, "text": t}.get(c) for c in docs.columns) for i, t in enumerate(texts)]
    odd = spark.createDataFrame(blank + rows + rows[3:5], docs.schema)
    marks = spark.read.parquet(f"{h.SF}/labels.parquet")
    for name, d, m in (("odd", odd, marks), ("unlabelled", odd, marks.limit(0)), ("empty", docs.limit(0), marks.limit(0))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        m.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in out} <= {None, *range(len(texts))} and (out or name != "unlabelled")
        assert not out or name != "empty"


def test_pipeline_rows_and_columns(spark, tmp_path):
    """Shared and missing ids lose no text, columns named like results stay as they are, a very long text stays whole; nothing but the result is left."""
    r = random.Random(6)
    prose = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(10**5)}" for _ in range(n))
    a, b, c, long = prose(80), prose(80), prose(80), prose(60_000)
    texts = [(3, a), (5, a), (5, b), (7, b), (None, c), (None, c), (11, long), (11, prose(90)), (12, long + " tail")]
    rows = [(i, t, "en", "s", len(t), "mine", float(k), "w", k) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, predicted double, n_lines string, gid int")
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    left = docs.collect()
    assert sorted(x.text.split()[0] for x in left if x.text) == sorted({t.split()[0] for _, t in texts})  # line dedup leaves a repeated line to its first id
    assert {(x.score, x.n_lines) for x in left} == {("mine", "w")} and all(x.predicted == x.gid for x in left)
    assert max(len(x.text) for x in left) >= len(long)
    out = corpus_pipeline.run(spark, str(tmp_path))
    tokens = sum(x.n_tokens for x in out.collect())
    assert tokens > 0
    left_behind = [f for f in glob.glob(f"{os.path.dirname(os.path.dirname(out.inputFiles()[0])).removeprefix('file://')}/*")]
    assert [os.path.basename(f) for f in left_behind] == ["4"]


def test_fingerprint_query(spark):
    """Every row of the registered query by hand: edited texts, lengths, likeness against the sets; and fingerprints of some by their bins."""
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{h.SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries()["op9_fingerprints"](spark, h.SF).collect()}
    assert len(got) == len(docs)
    prints, errors = {}, []
    for k, (i, t) in enumerate(docs):
        nxt, q, r = docs[(k + 1) % len(docs)][1], len(t) // 4, got[i]
        edited = t[: len(t) - q] + nxt[:q]
        assert (r.n_chars, r.edited_sha256) == (len(t), h.sha(edited))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint and prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        for x, told in ((edited, r.near_edited), (nxt, r.near_next)):
            a, b = h.shingles(t.lower(), 5), h.shingles(x.lower(), 5)
            assert 0 <= told <= 1 and (t != x or told == 1)
            if len(a | b) >= 40:
                errors.append(told - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.2
    for i, t in docs[:3]:
        assert got[i].fingerprint == "".join(f"{b + 128:02X}" for b in brute_bins(spark, t))


def test_packing_is_best_fit(spark):
    """The registered query replayed by brute force: each last piece, in order of size, went into the tightest window that was open and compatible."""
    docs = spark.read.parquet(f"{h.SF}/documents.parquet")
    known = {r.doc_id: r for r in docs.select("doc_id", "source", F.lower(F.coalesce("text", F.lit(""))).alias("t"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("uid")).collect()}
    last = {}
    for r in queries()["op4_best_fit_packing"](spark, h.SF).collect():
        if r.doc_id not in last or r.piece > last[r.doc_id].piece:
            last[r.doc_id] = r
    shards = {}
    for r in last.values():
        shards.setdefault(r.window >> 32, []).append(r)
    for rows in shards.values():
        open_ = {}
        for r in sorted(rows, key=lambda r: (-r.n_tokens, known[r.doc_id].uid, r.doc_id)):
            me = known[r.doc_id]
            cluster = me.t if r.n_tokens or r.piece else None
            fits = {w: room for w, (room, sources, texts) in open_.items() if room >= r.n_tokens and (me.source is None or me.source not in sources) and (cluster is None or cluster not in texts)}
            if r.window in open_:
                assert r.window in fits and fits[r.window] == min(fits.values()) and r.window_offset == 2048 - open_[r.window][0]
            else:
                assert not fits and r.window_offset == 0
            room, sources, texts = open_.setdefault(r.window, (2048, set(), set()))
            open_[r.window] = (room - r.n_tokens, sources | {me.source}, texts | {cluster})
