"""Small fixtures and brute-force versions for the operators' tests."""

import hashlib
import random
import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, kept string, score string, window string, bins int, topic string, text2 string"
WORD = rb"[^\x20\x09-\x0D]+"


def rows(texts, first=0):
    """(doc_id, text) with a hot source and null columns."""
    return [(first + i, t, None if i % 7 == 3 else "en", None if i % 5 == 4 else ("hot" if i % 3 == 0 else f"s{i % 4}"), None, "x", "y", "z", "w", 1, "t", None) for i, t in enumerate(texts)]


def edge_texts(seed=1):
    """Nulls, blanks, very long texts, copies, near copies, shared passages and lines, ties."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage, line = prose(120), prose(40), "A Common Line, seen very often"
    out = [None, "", " \n\t", "x", "one two three", "One TWO three", "one two three", base, base.upper(), base + " tail", base.replace(base[10:14], "zzzz", 1)]
    out += [prose(r.randint(3, 60)) + "\n" + passage + "\n" + prose(5) for _ in range(4)]
    out += [prose(4) + "\n" + line + "  \n" + prose(r.randint(1, 9)) + "\n" + line.lower() for _ in range(5)]
    out += [prose(6000) + "\n" + base, "a" * 5000, "a" * 3000 + "b", "ab" * 400, "ÄÖ ß é　中文 " * 30, "\n\n\n", "tab\tsep\x0bver\x0cff\rcr"]
    near = base.split()
    out += [" ".join(w if k % 40 != j else "new" for k, w in enumerate(near)) for j in range(6)]
    return out


def edge_docs(spark):
    data = rows(edge_texts())
    data += data[5:7]  # repeated rows
    data.append((None, "a text without an id, longer than ten", "en", "hot", 3, None, None, None, None, None, None, None))
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def brute_exact(data):
    norm = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for i, t in data:
        groups[norm(t)].append(i)
    return {i: (max(groups[norm(t)]), len(groups[norm(t)]), sha(norm(t))) for i, t in data}


def brute_lines(data, least=10):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    docs = defaultdict(set)
    for i, t in data:
        for s in (t or "").split("\n"):
            if len(key(s)) >= least:
                docs[key(s)].add(i)
    out = {}
    for i, t in data:
        lines = (t or "").split("\n")
        left = [s for s in lines if len(docs.get(key(s), ())) < 2 or min(docs[key(s)]) == i]
        out[i] = (len(lines), len(lines) - len(left), sha("\n".join(left)))
    return out


def brute_substrings(data, length=50):
    first = {}
    docs = sorted((i, (t or "").encode()) for i, t in data)
    for i, b in docs:
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], i)
    out = {}
    for i, b in docs:
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                cover[s : s + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if cover[p] and (p == 0 or not cover[p - 1]))
        out[i] = (len(b), sum(cover), spans, sha(bytes(c for c, k in zip(b, cover) if not k)))
    return out


def shingles(text, n):
    w = re.findall(WORD, (text or "").encode().lower())
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_near(data, n, percent=80):
    sets = {i: shingles(t, n) for i, t in data}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    for i, s in sets.items():
        common = Counter(j for x in s for j in held[x])
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}
