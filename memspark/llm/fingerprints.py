"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits, all in Spark SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shards_for

BINS, BITS, WORDS = 256, 8, 5
#: Probes of an empty bin, before all filled bins are looked at in an order of the bin's own.
PROBES = 8
LOW = (1 << 56) - 1
MOST_BUCKETS = 20_000


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def bins(text: Column) -> Column:
    """The 256 bins of a text's word shingles, as bytes from -128 to 127; an empty array for a text without words.

    Each shingle is hashed once: the top 8 bits choose the bin, the rest competes for the bin's minimum. A marker for
    each bin makes the sorted array hold every bin, so that the first of each bin is its minimum or the marker. An empty
    bin probes others in a fixed order of its own, the same for every text, and takes over the value of the first that
    a shingle filled: two texts agree in a bin with the probability of their likeness. The first PROBES places of that
    order are hashes of bin and place; the order of the rest is that of hashes of the two bins.
    """
    words = F.array_remove(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n = lambda w: F.size(w)

    def shingles(w: Column) -> Column:
        at = F.sequence(F.lit(0), n(w) - WORDS)
        whole = F.array(F.aggregate(w, F.lit(42).cast("long"), lambda acc, x: F.xxhash64(acc, x)))
        return F.when(n(w) >= WORDS, F.transform(at, lambda i: F.xxhash64(*[w[i + k] for k in range(WORDS)]))).otherwise(whole)

    markers = F.expr(f"transform(sequence(-{BINS // 2}, {BINS // 2 - 1}), b -> shiftleft(cast(b as bigint), 56) | {LOW}L)")

    def minima(s: Column) -> Column:
        first = F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(s[F.greatest(i - 1, F.lit(0))], 56)))
        low = F.transform(first, lambda x: x.bitwiseAND(F.lit(LOW)))
        return F.transform(low, lambda x: F.when(x == LOW, F.lit(-1).cast("long")).otherwise(x))

    def fill(own: Column) -> Column:
        """Of the bins' own values the donor's for each empty bin."""
        donors = F.filter(F.transform(own, lambda x, j: F.struct(j.alias("j"), x.alias("x"))), lambda d: d["x"] != -1)
        probe = lambda j, r: own[F.pmod(F.xxhash64(j, F.lit(r)), F.lit(BINS)).cast("int")]
        early = lambda j: F.coalesce(*[F.nullif(probe(j, r), F.lit(-1).cast("long")) for r in range(1, PROBES + 1)])
        late = lambda j, some: F.array_min(F.transform(some, lambda d: F.struct(F.xxhash64(j, d["j"]).alias("h"), d["x"].alias("x"))))["x"]
        filled = _let(donors, lambda some: F.transform(own, lambda x, j: F.when(x != -1, x).otherwise(F.coalesce(early(j), late(j, some)))))
        return F.when(F.array_contains(own, F.lit(-1).cast("long")), filled).otherwise(own)

    dense = _let(_let(F.sort_array(F.concat(_let(hashes, shingles), markers)), minima), fill)
    # Each bin folds its value in its own way: bins that hold one value don't agree by one chance.
    low = F.transform(dense, lambda x, j: (F.xxhash64(x, j).bitwiseAND(F.lit(255)) - 128).cast("tinyint"))
    return F.when(F.length(F.trim(text)) == 0, F.array().cast("array<tinyint>")).otherwise(F.when(n(words) == 0, F.array().cast("array<tinyint>")).otherwise(low))


def packed(b: Column) -> Column:
    """Two hexadecimal digits a bin; the empty string for a text without words."""
    return F.array_join(F.transform(b, lambda x: F.substring(F.hex(x.cast("long") + (128 + 256)), 2, 2)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: the share of equal bins, less what BITS low bits agree in by chance. Two texts without words are alike."""
    chance = 1 / (1 << BITS)
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    share = F.greatest(F.lit(0.0), (equal / BINS - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(share)


def fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """The input with a fingerprint column (512 hexadecimal digits; empty for null texts and texts without words), an existing one replaced."""
    return docs.withColumn(out, packed(bins(F.coalesce(F.col(text_col), F.lit("")))))


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """The rows with next_<column> of the row that follows in ascending id_col; the first follows the last.

    Rows are dealt to ranges of ids with about as many rows each, and the first row of a range also goes to the end of
    the range before it, so that each range is put in order by itself. A row finds its range in two steps: among every
    so many of the cut points, then among those between. Null ids come first.
    """
    n = min(MOST_BUCKETS, 4 * shards_for(docs))
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    probabilities = [k / n for k in range(1, n)] or [0.5]
    found = ids.agg(F.min("i").alias("low"), F.percentile_approx("i", probabilities, max(10_000, 20 * n)).alias("cuts"), F.count_if(F.col("i").isNull()).alias("nulls")).first()
    low, nulls = found["low"], found["nulls"] > 0
    cuts = sorted({c for c in found["cuts"] or [] if c > low})
    i = F.col(id_col).cast("long")
    own, is_cut = F.lit(0), F.lit(False)
    if cuts:
        stride = max(1, round(len(cuts) ** 0.5))
        longs = lambda xs: F.array(*[F.lit(c) for c in xs]).cast("array<bigint>")
        groups = [cuts[a : a + stride] for a in range(0, len(cuts), stride)]
        at = F.size(F.filter(longs([g[0] for g in groups]), lambda c: c <= i))
        inside = F.get(F.array(*[longs(g) for g in groups]), at - 1)
        own = F.coalesce(F.when(at > 0, (at - 1) * stride + F.size(F.filter(inside, lambda c: c <= i))), F.lit(0))
        is_cut = F.coalesce(F.array_contains(inside, i), F.lit(False))
    first = i.isNull() if nulls else i == low
    ghost = F.when(first, F.lit(len(cuts))).when(is_cut, own - 1)
    place = F.array_compact(F.array(F.struct(own.alias("bucket"), F.lit(0).alias("ghost")), F.when(ghost.isNotNull(), F.struct(ghost.cast("int").alias("bucket"), F.lit(1).alias("ghost")))))
    dealt = docs.select("*", F.inline(place))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col(id_col).asc_nulls_first(), *[F.col(c) for c in columns if dict(docs.dtypes)[c] == "string"])
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("ghost = 0").drop("bucket", "ghost")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter of its code points replaced by the first as many of the next document in
    ascending id (after the last, the first). Null counts as empty; rows repeated with one id follow each other in order
    of their texts; a null id comes first. Equal texts have equal fingerprints. An empty table gives no rows; further
    columns are ignored.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(slim.withColumn("bins", bins(F.col("text"))), "doc_id", ["text", "bins"])
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited_text"), "bins", "next_bins")
    rows = rows.withColumn("edited_bins", bins(F.col("edited_text")))
    return rows.select("doc_id", "n_chars", "edited_text", packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"), likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"))
