"""Column builders for text: normalisation, hashes, n-grams, tokens, and the classifiers of stored text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import IMPORT_STRATEGIES, KNOWLEDGE_TYPES

# Words that mark narrative and factual text, words that are no keywords, default chunk sizes.
NARRATIVE_MARKERS = ("然后", "接着", "于是", "后来", "最后", "突然", "一天", "曾经", "有一次", "从前", "说道", "问道", "想着", "觉得")
FACTUAL_MARKERS = ("是", "有", "在", "为", "属于", "位于", "包含", "拥有", "成立于", "出生于")
STOP_WORDS = ("the", "and", "that", "this", "with", "from", "for", "have", "will", "your", "you", "我们", "你们", "他们", "以及", "一个", "这个", "那个", "然后", "因为", "所以")
CHUNK_SIZES = {"structured": 300, "narrative": 800, "factual": 500, "quote": 400, "mixed": 500}


#: Unicode white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: The same for regular expressions, without tab, line feed and space.
_BLANK = r"\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends; null is empty."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES))


def normalize(c: Column) -> Column:
    """stripped, line ends as \\n, other white space runs as one space. Single spaces, the usual case, match nothing."""
    lines = F.replace(F.replace(strip(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    # Most places are passed over by the look ahead: the classes' many ranges are slow to try.
    return F.regexp_replace(lines, rf"(?![!-~]| [!-~])(?:[\t{_BLANK}\x20]{{2,}}|[\t{_BLANK}])", " ")


def content_hash(c: Column, kind: str = "sha256") -> Column:
    """hex digest of the UTF-8 bytes."""
    return F.md5(c) if kind == "md5" else F.sha2(c, 256)


def hash_key(kind: Column, value: Column) -> Column:
    """kind-hash."""
    return F.concat_ws("-", kind, value)


def parse_hash_key(key: Column) -> Column:
    """struct(kind, hash); the hash keeps further dashes."""
    parts = F.split(key, "-", 2)
    return F.struct(parts[0].alias("kind"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("hash"))


def canonical(c: Column) -> Column:
    """identity of names: stripped, lower case."""
    return F.lower(strip(c))


def entity_hash(name: Column) -> Column:
    return F.sha2(canonical(name), 256)


def relation_hash(s: Column, p: Column, o: Column) -> Column:
    """Digest of the canonical triple."""
    return F.sha2(F.concat_ws("|", canonical(s), canonical(p), canonical(o)), 256)


def compact(c: Column) -> Column:
    """Lower-case text without white space."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", "")


def char_ngrams(c: Column, n: int = 2) -> Column:
    """n-grams of the lower-case text without white space; shorter text is its own n-gram; none for empty text."""
    t = compact(c)

    def grams(chars: Column) -> Column:
        at = lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)])
        return F.when(F.size(chars) < n, F.array(F.array_join(chars, ""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(chars) - n), at))

    # The text is taken apart once, and bound as a variable: each n-gram costs the same, however long the text.
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.transform(F.array(F.split(t, "")), grams)[0])


_NO_WORD = r"(?![a-z0-9])[^\p{L}\p{N}_]+"


def words(c: Column) -> Column:
    """Lower-case tokens of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), _NO_WORD), "")


def spaced_words(c: Column) -> Column:
    """The same tokens as one text, with spaces between: no array of millions of short strings is made of long texts."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _NO_WORD, " ")


def tokens(c: Column, mode: str = "word", n: int = 2) -> Column:
    """Distinct tokens in order of appearance: words, char n-grams, or both."""
    parts = {"word": [words(c)], "char_ngram": [char_ngrams(c, n)], "mixed": [words(c), char_ngrams(c, n)]}[mode]
    return F.array_distinct(F.concat(*parts))


def word_count(c: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(c, F.lit("")), rf"(?![!-~])[\t\n{_BLANK}\x20]+"), ""))


def _count_markers(c: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(0)
    for m in markers:
        found = found + c.contains(m).cast("int")
    return found


def is_structured(c: Column) -> Column:
    """exactly three non-blank parts between pipes."""
    parts = F.split(strip(c), r"\|")
    return (F.size(parts) == 3) & F.forall(parts, lambda x: strip(x) != "")


def is_quote(c: Column) -> Column:
    """five or more non-blank lines of under 20 characters on average."""
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"), lambda x: strip(x) != "")
    total = F.aggregate(lines, F.lit(0), lambda s, x: s + F.char_length(x))
    return (F.size(lines) >= 5) & (total / F.greatest(F.size(lines), F.lit(1)) < 20)


def is_narrative(c: Column) -> Column:
    """a chapter mark in the first 500 characters, dialogue, or two narrative markers."""
    t = strip(c)
    head = F.substring(t, 1, 500)
    chapter = head.contains("Chapter") | head.contains("CHAPTER") | head.contains("###")
    # Fixed value: what reads like dialogue.
    dialogue = t.rlike('["「『].*?["」』]')
    return (t != "") & (chapter | dialogue | (_count_markers(t, NARRATIVE_MARKERS) >= 2))


def is_factual(c: Column) -> Column:
    """neither structured nor a quote, with a factual marker; above 240 characters two and no narrative."""
    t = strip(c)
    n = _count_markers(t, FACTUAL_MARKERS)
    return (t != "") & ~is_structured(t) & ~is_quote(t) & (n > 0) & ((F.char_length(t) <= 240) | (n >= 2) & ~is_narrative(t))


def knowledge_type(c: Column) -> Column:
    """structured, quote, factual, narrative, else mixed."""
    blank = strip(c) == ""
    return F.when(blank, "mixed").when(is_structured(c), "structured").when(is_quote(c), "quote").when(is_factual(c), "factual").when(is_narrative(c), "narrative").otherwise("mixed")


def import_strategy(c: Column, override: Column | None = None, chat_log: Column | None = None) -> Column:
    """narrative for chat logs, a valid override, else quote, factual, narrative by content."""
    found = F.when(is_quote(c), "quote").when(is_factual(c), "factual").otherwise("narrative")
    if override is not None:
        name = canonical(override)
        found = F.when(name.isin(*[s for s in IMPORT_STRATEGIES if s != "auto"]), name).otherwise(found)
    return found if chat_log is None else F.when(chat_log, "narrative").otherwise(found)


def stored_type(value: Column, content: Column, legacy: bool = False, fallback: str | None = None) -> Column:
    """a valid stored type from a name or strategy; auto or blank is detected; null if nothing fits."""
    v = canonical(value)
    detected = F.when(strip(content) != "", knowledge_type(content))
    out = F.when(v.isin(*KNOWLEDGE_TYPES), v).when(v.isin("", "auto"), detected)
    if legacy:
        out = out.when(v == "imported", "factual").otherwise(F.coalesce(detected, F.lit(fallback)))
    return out


def type_from_hint(hint: Column, content: Column) -> Column:
    """A hint if there is one, else by content."""
    return F.when(strip(hint) != "", stored_type(hint, content)).otherwise(knowledge_type(content))


def extracts_relations(kind: Column) -> Column:
    """F13"""
    return kind.isin("structured", "factual", "mixed")


def chunk_size(kind: Column) -> Column:
    """F13"""
    sizes = F.create_map(*[F.lit(x) for kv in CHUNK_SIZES.items() for x in kv])
    return F.coalesce(sizes[kind], F.lit(500))


def keep_order(items: Column) -> Column:
    """trimmed, without blanks, first spelling of each case-insensitive name, in order."""
    cleaned = F.filter(F.transform(items, strip), lambda x: x != "")
    low = F.transform(cleaned, F.lower)
    return F.filter(cleaned, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def json_list(raw: Column) -> Column:
    """a JSON list of strings; anything else is an empty list."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def clamp(c: Column, low: float, high: float, default: float | None = None) -> Column:
    """within bounds; what is no number is the default."""
    n = F.expr("null") if c is None else c.try_cast("double")
    return F.least(F.greatest(F.coalesce(n, F.lit(default)), F.lit(low)), F.lit(high))


def as_bool(c: Column, default: bool = False) -> Column:
    """F20, P20"""
    v = canonical(c.cast("string"))
    return F.when(v.isin("1", "true", "yes", "on", "y"), True).when(v.isin("0", "false", "no", "off", "n"), False).otherwise(default)


def key_values(c: Column) -> Column:
    """P20: map of k=v pairs; values may be in double or single quotes."""
    pairs = F.regexp_extract_all(c, F.lit(r"""([\w-]+=(?:"[^"]*"|'[^']*'|\S+))"""), F.lit(1))
    entry = lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(F.substring(p, F.instr(p, "=") + 1, F.char_length(p)), r"""^["']|["']$""", "").alias("v"))
    return F.map_from_entries(F.transform(pairs, entry))
