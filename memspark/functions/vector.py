"""Column builders for vectors: products, normalisation, checks and quantisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length, as doubles; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def is_valid(v: Column, dim: int | None = None) -> Column:
    """not null, not empty, finite, of the given dimension."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))
    return ok if dim is None else ok & (F.size(v) == dim)


def quantize_int8(v: Column) -> Column:
    """struct(codes -128..127, lo, hi); with lo and hi the code can be undone."""
    lo, hi = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    span = F.when(hi > lo, hi - lo).otherwise(1.0)
    codes = F.transform(v, lambda x: (F.rint((x.cast("double") - lo) / span * 255) - 128).cast("int"))
    return F.struct(codes.alias("codes"), lo.alias("lo"), hi.alias("hi"))


def dequantize_int8(q: Column) -> Column:
    """within half a step of the vector."""
    span = F.when(q["hi"] > q["lo"], q["hi"] - q["lo"]).otherwise(0.0)
    return F.transform(q["codes"], lambda c: (c + 128) / 255.0 * span + q["lo"])


def product_quantize(v: Column, m: int = 8, k: int = 256) -> Column:
    """F16: struct(codes, lo, hi): each of m parts as the nearest of k evenly spaced levels to its mean."""
    lo, hi = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    width = (F.size(v) / m).cast("int")
    step = F.when(hi > lo, (hi - lo) / (k - 1)).otherwise(1.0)

    def code(i: Column) -> Column:
        part = F.slice(v, i * width + 1, width)
        return F.rint((F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double")) / width - lo) / step).cast("int")

    return F.struct(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), code).alias("codes"), lo.alias("lo"), hi.alias("hi"))


def product_dequantize(q: Column, width: int, k: int = 256) -> Column:
    """F16: each level repeated over its part."""
    step = (q["hi"] - q["lo"]) / (k - 1)
    return F.flatten(F.transform(q["codes"], lambda c: F.array_repeat(q["lo"] + c * step, width)))


def vector_id(key: Column) -> Column:
    """63-bit number from the first 16 hex digits of sha1."""
    head = F.substring(F.sha1(key), 1, 16)
    top = F.conv(F.substring(head, 1, 1), 16, 10).cast("int").bitwiseAND(F.lit(7))
    return F.conv(F.concat(F.lower(F.hex(top)), F.substring(head, 2, 15)), 16, 10).cast("bigint")


def bytes_saved(n: int, dim: int, source_bits: int = 32, target_bits: int = 8) -> dict[str, float]:
    """Sizes before and after, and the share saved."""
    before, after = n * dim * source_bits / 8, n * dim * target_bits / 8
    return {"before_bytes": before, "after_bytes": after, "saved_ratio": 1 - after / before if before else 0.0, "ratio": before / after if after else 0.0}
