"""Column builders for time: parsing, effective intervals and overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats that are read.
_FORMATS = (
    (r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$", "yyyy/MM/dd HH:mm:ss"),
    (r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}$", "yyyy/MM/dd HH:mm"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
)
END_OF_DAY = 23 * 3600 + 59 * 60


def _epoch(c: Column, pattern: str) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(c, F.lit(pattern))).cast("double")


def parse_query_time(c: Column, is_end: bool = False) -> Column:
    """epoch seconds of YYYY/MM/DD or YYYY/MM/DD HH:mm; a date as an end is 23:59; null if malformed."""
    t = F.trim(c)
    day = _epoch(t, "yyyy/MM/dd") + (END_OF_DAY if is_end else 0)
    return F.when(t.rlike(r"^\d{4}/\d{2}/\d{2}$"), day).when(t.rlike(r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}$"), _epoch(t, "yyyy/MM/dd HH:mm"))


def parse_query_range(start: Column, end: Column) -> Column:
    """struct(ts_from, ts_to, ok); not ok if a bound is malformed or the range is reversed."""
    a, b = parse_query_time(start), parse_query_time(end, True)
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    ok = (~given(start) | a.isNotNull()) & (~given(end) | b.isNotNull()) & F.coalesce(a <= b, F.lit(True))
    return F.struct(a.alias("ts_from"), b.alias("ts_to"), ok.alias("ok"))


def parse_ingest_time(c: Column, is_end: bool = False) -> Column:
    """epoch seconds of a number or one of eight formats; null if none fits."""
    t = F.trim(c.cast("string"))
    out = F.when(t.rlike(r"^-?\d+(\.\d+)?$"), t.try_cast("double"))
    for shape, pattern in _FORMATS:
        extra = END_OF_DAY if is_end and "H" not in pattern else 0
        out = out.when(t.rlike(shape), _epoch(t, pattern) + extra)
    return out


def time_meta(event: Column, start: Column, end: Column, range_start: Column, range_end: Column, granularity: Column, confidence: Column) -> Column:
    """struct of normalised time columns and ok (false for a reversed range)."""
    a = F.coalesce(parse_ingest_time(start), parse_ingest_time(range_start))
    b = F.coalesce(parse_ingest_time(end, True), parse_ingest_time(range_end, True))
    minute = F.coalesce(event.contains(":"), F.lit(False)) | F.coalesce(start.contains(":"), F.lit(False)) | F.coalesce(end.contains(":"), F.lit(False))
    grain = F.coalesce(F.nullif(granularity, F.lit("")), F.when(minute, "minute").otherwise("day"))
    return F.struct(parse_ingest_time(event).alias("event_time"), a.alias("event_time_start"), b.alias("event_time_end"), grain.alias("time_granularity"), confidence.try_cast("double").alias("time_confidence"), F.coalesce(a <= b, F.lit(True)).alias("ok"))


def format_time(ts: Column) -> Column:
    """YYYY/MM/DD HH:mm in the session's time zone."""
    return F.date_format(F.timestamp_seconds(ts), "yyyy/MM/dd HH:mm")


def effective_start(created_fallback: bool = True) -> Column:
    """Start of a paragraph's effective interval."""
    return F.coalesce(*[F.col(c) for c in ("event_time_start", "event_time", "event_time_end", *(["created_at"] if created_fallback else []))])


def effective_end(created_fallback: bool = True) -> Column:
    return F.coalesce(*[F.col(c) for c in ("event_time_end", "event_time", "event_time_start", *(["created_at"] if created_fallback else []))])


def overlaps(start: Column, end: Column, lower: float | Column | None, upper: float | Column | None) -> Column:
    """The interval meets [lower, upper]; an open bound excludes nothing, an interval without time meets no bound."""
    ok = F.lit(True)
    if lower is not None:
        ok = ok & F.coalesce(end >= lower, F.lit(False))
    if upper is not None:
        ok = ok & F.coalesce(start <= upper, F.lit(False))
    return ok


def match_basis(created_fallback: bool = True) -> Column:
    """what the effective interval comes from."""
    timed = F.col("event_time_start").isNotNull() | F.col("event_time_end").isNotNull()
    return F.when(timed, "event_time_range").when(F.col("event_time").isNotNull(), "event_time").when(F.lit(created_fallback) & F.col("created_at").isNotNull(), "created_at_fallback").otherwise("none")
