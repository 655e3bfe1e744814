"""Fill-in-the-middle, the filter audit and token counts against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from memspark.llm.fill_middle import MARKS, fill_middle, restore
from memspark.llm.filter_audit import audit, steps
from memspark.llm.queries import oracle_sql, queries
from memspark.llm.token_counts import count_tokens, default_path, load, prove
from pyspark.sql import functions as F

from . import helpers as h


def brute_fill(i, text, salt="1", rate=90, spm=20):
    t = text or ""
    xs = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    d = hashlib.sha256(f"{salt}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    if not t or any(m in t for m in MARKS) or h3 % 100 >= rate:
        return i, len(xs), "plain", None, None, t
    a, z = sorted((h1 % (len(xs) + 1), h2 % (len(xs) + 1)))
    p, m, s = "".join(xs[:a]), "".join(xs[a:z]), "".join(xs[z:])
    if h4 % 100 < spm:
        return i, len(xs), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(xs), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_docs(spark):
    """The edge table, and texts with marks, halves of marks, zero characters and one very long text."""
    more = ["<P>", "a<S", "S>b<", "<", "<M> x", "P><S", "<<P<M<S", "nul\0 and more words", "x" * 300_000 + "<" * 5, "é\U0001f600中 word\r\n" * 20_000]
    return h.edge_docs(spark).unionByName(spark.createDataFrame(h.rows(more * 3, 1000), h.SCHEMA)).repartition(3)


def test_fill_middle(spark):
    docs = odd_docs(spark)
    want = Counter(brute_fill(r.doc_id, r.text) for r in docs.collect())
    made = fill_middle(docs)
    assert Counter(map(tuple, made.collect())) == want
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}
    back = made.select("doc_id", restore(F.col("output"), F.col("form")).alias("text"))
    assert Counter(map(tuple, back.collect())) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert fill_middle(h.empty_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        fill_middle(docs, marks=("<P>", "P>", "<M>"))
    with pytest.raises(ValueError):
        fill_middle(docs, marks=("ab", "bc", "<M>"))


def test_fill_middle_parameters(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words, "), "id").alias("text"))
    got = Counter(r.form for r in fill_middle(docs, salt="x", rate=100, spm=50).collect())
    assert "plain" not in got and min(got.values()) > 150
    got = {tuple(r) for r in fill_middle(docs, salt="7", rate=40, spm=80).collect()}
    assert got == {brute_fill(r.doc_id, r.text, "7", 40, 80) for r in docs.collect()}


def brute_audit(data, labels):
    """Runs every order over every document."""
    first = {}
    for i, t, _ in data:
        key = (i is not None, i or 0)
        first[t or ""] = min(first.get(t or "", key), key)
    good, toxic = ({i for i, q, x in labels if i is not None and v(q, x) == 1} for v in (lambda q, x: q, lambda q, x: x))
    fails = []
    for i, t, part in data:
        t = t or ""
        w = [x for x in re.split("[\\x20\\x09-\\x0D]+", t) if x]
        f = ""
        f += "A" if len(w) < 50 else ""
        f += "B" if 100 * len(set(w)) < 65 * len(w) else ""
        f += "C" if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else ""
        f += "D" if re.search("[#$%&*|]", t) else ""
        f += "E" if (i is not None, i or 0) > first[t] else ""
        fails.append((part or "", f, i in good, i in toxic))
    out = {(p, "".join(o), k + 1): [0] * 6 for p in {x[0] for x in fails} for o in permutations("ABCDE") for k in range(5)}
    total = Counter()
    for p, f, g, x in fails:
        for o in permutations("ABCDE"):
            gone = False
            for k, c in enumerate(o):
                r = out[p, "".join(o), k + 1]
                if c in f:
                    r[2 if gone else 1] += 1
                    r[3] += f == c
                    if not gone:
                        r[4] += g
                        r[5] += x
                        total[p, c] += 1
                    gone = True
                r[0] += not gone
    return {(p, o, k, *r, total[p, o[k - 1]]) for (p, o, k), r in out.items()}


def test_audit(spark):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = h.edge_texts() + ["", None, "ABC" * 40] + [" ".join(r.choices(vocabulary[: r.choice((20, 400))], k=r.randint(30, 90))) + r.choice(("", " 50%", " SOME UPPER CASE WORDS", " a|b")) for _ in range(60)]
    texts += texts[-30:]
    data = h.rows(texts) + h.rows(texts)[5:9] + [(None, texts[-1], None, "", None, *[None] * 7), (None, texts[-1], None, None, None, *[None] * 7)]
    docs = spark.createDataFrame(data, h.SCHEMA).repartition(4)
    marks = [(i, r.choice((0, 1, None)), r.choice((0, 1, None))) for i in range(0, len(texts), 2)] + [(4, 0, 1), (None, 1, 1), (99999, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    want = brute_audit([(x[0], x[1], x[3]) for x in data], marks)
    got = {tuple(x) for x in audit(docs, labels).collect()}
    assert got == want and len(want) == 600 * len({x[3] or "" for x in data})
    assert any(x[4] and x[5] and x[6] and x[7] and x[8] for x in want)
    assert audit(h.empty_docs(spark), labels.limit(0)).count() == 0
    alone = audit(docs.select("doc_id", "text")).collect()
    assert {tuple(x) for x in alone} == brute_audit([(x[0], x[1], None) for x in data], [])


def test_audit_totals(spark):
    """In every order the removed and the kept add up, and shares over all orders add up to what is removed."""
    got = queries()["op12_filter_audit"](spark, h.SF).toPandas()
    whole = spark.read.parquet(f"{h.SF}/documents.parquet").groupBy(F.coalesce("source", F.lit("")).alias("part")).count().toPandas().set_index("part")["count"]
    last = got[got.step == 5].set_index(["part", "filter_order"])
    gone = got.groupby(["part", "filter_order"]).removed.sum()
    assert ((last.kept + gone).sort_index() == whole.reindex(last.sort_index().index.get_level_values("part")).values).all()
    fair = got[got.filter_order == "ABCDE"].groupby("part").shapley.sum()
    assert (fair == 120 * gone.groupby("part").first()).all()
    assert steps(spark).count() == 32 * 120 * 5


ODD = [
    "", " ", "  ", "\n", "\t", " a", "a ", "  a  b   c  ", "▁a", "a▁b", "▁", "▁▁ ▁", "a\n b", "\n\n  x", "<s>", "</s> <unk> <0x0A>", "<0x41>", "\0", "a\0b", "é", "é", "ﬁ ①", "中文字符，标点。", "日本語のテキスト",
    "русский текст", "العربية", "\U0001f600\U0001f601 x", "1234567890", "3.14159", "don't", "hello,world", "HELLO WORLD", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 70, "-" * 33 + " " * 41 + "x", "  nbsp", "http://a.b/c?d=e&f=g#h", "def f(x):\n    return x\n", "�﻿", "⁇ ", "x" * 20_000, "中" * 5000, " " * 3000,
]


def brute_counts(texts):
    with open(default_path(), "rb") as f:
        sp = load(f.read())
    return [len(x) for x in sp.encode([t or "" for t in texts])]


def test_token_counts(spark):
    r = random.Random(9)
    with open(default_path(), "rb") as f:
        sp = load(f.read())
    some = [sp.id_to_piece(i) for i in r.choices(range(3, 32000), k=4000)]
    texts = ODD + h.edge_texts() + ["".join(r.choices(some, k=r.randint(1, 60))).replace("▁", r.choice((" ", "▁"))) for _ in range(1500)]
    texts += ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(32, 127), r.randrange(0x20, 0x3000), 10, 32, 0x2581))) for _ in range(r.randint(1, 80))) for _ in range(1500)]
    data = h.rows(texts) + h.rows(texts)[5:9] + [(None, "no id", *[None] * 10)]
    got = count_tokens(spark.createDataFrame(data, h.SCHEMA).repartition(3)).collect()
    want = Counter((x[0], len((x[1] or "").encode()), n, n > 4096) for x, n in zip(data, brute_counts([x[1] for x in data]), strict=True))
    assert Counter(map(tuple, got)) == want
    assert count_tokens(h.empty_docs(spark)).count() == 0


def test_token_counts_query(spark):
    """Every row of the registered query, by the library alone."""
    docs = spark.read.parquet(f"{h.SF}/documents.parquet").collect()
    want = {d.doc_id: (len((d.text or "").encode()), n, n > 4096) for d, n in zip(docs, brute_counts([d.text for d in docs]), strict=True)}
    assert {r.doc_id: tuple(r[1:]) for r in queries()["op13_token_counts"](spark, h.SF).collect()} == want
    some = count_tokens(spark.read.parquet(f"{h.SF}/documents.parquet"), limit=100).where("over_limit <> (n_tokens > 100)")
    assert some.count() == 0


def test_proof():
    """Most of the vocabulary is proven; strings that merging reaches otherwise aren't."""
    with open(default_path(), "rb") as f:
        model = f.read()
    cut, whole, wall = prove(model)
    sp = load(model)
    assert 25_000 < len(whole) < sp.get_piece_size() - 256 and wall == "\n"
    for s in whole[::997]:
        assert len(sp.encode(wall + s)) == len(sp.encode(wall)) + 1
    assert not cut[ord(" ") << 8 | ord("a")] and cut[ord("a") << 8 | ord(" ")] and cut[ord("\n") << 8 | ord("a")]


def test_sql_registered():
    assert {"op11_fill_middle", "op12_filter_audit"} <= set(oracle_sql())
