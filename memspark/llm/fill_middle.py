"""Fill-in-the-middle transformation: each Arrow batch is a table of DuckDB, whose SQL cuts and reorders the texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, tune

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: What a text is cut into: runs of ASCII letters, and all other code points one by one.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Bytes of text that are registered together.
PIECE = 2 << 20

SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256($salt || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM batch),
u AS (SELECT doc_id, t, regexp_extract_all(t, $unit) AS xs, [CAST('0x' || substr(h, 8 * i + 1, 8) AS UBIGINT) FOR i IN range(4)] AS hs FROM d),
n AS (SELECT *, len(xs) AS n, list_transform(hs[1:2], lambda x: CAST(x % (len(xs) + 1) AS BIGINT)) AS cuts FROM u),
f AS (SELECT *, list_min(cuts) AS a, list_max(cuts) AS z,
             CASE WHEN t = '' OR contains(t, $p) OR contains(t, $s) OR contains(t, $m) OR hs[3] % 100 >= $rate THEN 'plain' WHEN hs[4] % 100 < $spm THEN 'spm' ELSE 'psm' END AS form FROM n),
c AS (SELECT doc_id, t, n, form,
             CASE WHEN form <> 'plain' THEN array_to_string(list_slice(xs, 1, a), '') END AS prefix,
             CASE WHEN form <> 'plain' THEN array_to_string(list_slice(xs, a + 1, z), '') END AS middle,
             CASE WHEN form <> 'plain' THEN array_to_string(list_slice(xs, z + 1, n), '') END AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
       CASE form WHEN 'psm' THEN $p || prefix || $s || suffix || $m || middle WHEN 'spm' THEN $s || suffix || $p || prefix || $m || middle ELSE t END AS output
FROM c
"""
OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_middle(docs: DataFrame, salt: str = "1", rate: int = 90, spm: int = 20, marks: tuple[str, str, str] = MARKS, memory: str = "1GB", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output.

    A text is cut into n units. h1 to h4 are the first 8-digit groups of the hex sha256 of "salt:doc_id"; the prefix ends
    after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. `rate` percent of the texts (by
    h3) are reordered, and of these `spm` percent (by h4) have the suffix first. The rest, empty texts and those that hold
    a mark stay as they are (form plain, lengths null). Lengths are code points. Null texts are empty; a null id hashes as
    "salt:". Repeated rows are transformed alike; an empty table gives no rows; further columns, whatever their names, are
    ignored. A DuckDB of a task has one thread, `memory` at most and no folder to spill to; a batch holds about 2 MB of
    text, or one longer text.
    """
    if not all(marks) or any(a in b for a in marks for b in marks if a is not b) or any(x[k:] and y.startswith(x[k:]) for x in marks for y in marks for k in range(1, len(x))):
        raise ValueError("marks must not be empty, lie in one another or overlap")
    tune(docs.sparkSession)
    given = {"salt": salt, "unit": UNIT, "rate": rate, "spm": spm} | dict(zip("psm", marks, strict=True))
    sql, out = SQL, OUT

    def run(batches):
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        for b in pieces(batches, "text", PIECE):
            con.register("batch", pa.Table.from_batches([b]))
            t = con.sql(sql, params=given).to_arrow_table().cast(out)
            con.unregister("batch")
            yield from t.to_batches()
        con.close()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of."""
    p, s, m = (F.lit(x) for x in marks)
    part = lambda text, mark, k: F.split_part(text, mark, F.lit(k))
    head, middle = part(output, m, 1), part(output, m, 2)
    psm = F.concat(part(part(head, s, 1), p, 2), middle, part(head, s, 2))
    spm = F.concat(part(head, p, 2), middle, part(part(head, p, 1), s, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
