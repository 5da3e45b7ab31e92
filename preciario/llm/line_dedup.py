"""Removal of cross-site boilerplate lines by their distinct-site spread.

A line is boilerplate if it stands on at least ``min_sites`` sites, between at least as many different neighbours.  The
neighbours of an occurrence are the nearest lines before and after it that are neither blank nor themselves on
``min_sites`` sites.  So copies of a text, on however many sites, are one occurrence and lose nothing; frames of blank lines
and the other lines of a block don't matter; no number of copies or pages of one template keeps a line that is boilerplate
elsewhere; and no site's order or name enters.

Both counts come from HyperLogLog sketches per line hash, which merge in the map-side and final aggregation: what
is shuffled by line are sketches, so a line that holds a third of all rows costs no more than any other.  Lines whose estimate lies
within ``SIGMAS`` standard errors of the threshold are counted exactly, on distinct pairs, before anything is removed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preciario.llm.shared import discard, written

MIN_SITES = 10
#: Sketches of 2^12 registers: a standard error of 1.04 / 64.
LOG_REGISTERS = 12
SIGMAS = 5
ERROR = SIGMAS * 1.04 / math.sqrt(1 << LOG_REGISTERS)

BLANKS = " \t\r"
#: Lines that are dealt over several tasks at most, and over how many.
HOT, SALTS = 1000, 64


def hashed(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(BLANKS)))


def line_rows(docs: DataFrame, text: str, site: str) -> DataFrame:
    """line (hash) and site (hash, null if none) of each line that isn't blank."""
    lines = docs.select(F.when(F.col(site).isNotNull(), F.xxhash64(site)).alias("site"), F.explode(F.split(F.col(text), "\n")).alias("content"))
    return lines.where(F.trim("content", F.lit(BLANKS)) != "").select(hashed(F.col("content")).alias("line"), "site")


def widespread(rows: DataFrame, value: str, least: int) -> DataFrame:
    """line and n (rows) of the lines that stand with at least ``least`` distinct values; nulls are none."""
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg(value, F.lit(LOG_REGISTERS)))
    sketched = rows.groupBy("line").agg(F.count(value).alias("n"), estimate.alias("estimate"))
    margin = math.ceil(least * ERROR)
    judged = written(sketched.where(F.col("estimate") >= least - margin), "spread")
    near = judged.where(F.col("estimate") <= least + margin).select("line", "n")
    exact = rows.where(F.col(value).isNotNull()).distinct().join(near, "line").groupBy("line", "n").agg(F.count(F.lit(1)).alias("values"))
    sure = judged.where(F.col("estimate") > least + margin).select("line", "n")
    found = written(sure.unionByName(exact.where(F.col("values") >= least).select("line", "n")), "wide-lines")
    discard(judged)
    return found


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", key: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with boilerplate lines taken out of ``text``, plus n_lines and n_removed.

    A null text stays null, an empty one empty; blank lines are never removed; a row with a null site counts
    for no line, but loses its boilerplate.  Lines are compared without blanks at their ends.  Repeated rows and null keys are
    rows of their own.  Every row is kept, also one that has only boilerplate (its text is empty).
    Columns named n_lines or n_removed are replaced.
    """
    wide = widespread(line_rows(docs, text, site), "site", min_sites)
    candidates = written(hits(docs, wide, text, key), "candidates")
    found = widespread(contexts(docs, candidates, text, site, key), "context", min_sites)
    removed = candidates.select("__place", F.explode("__hits").alias("line")).join(found, "line", "left_semi")
    removed = written(removed.groupBy("__place").agg(F.collect_set("line").alias("__hits")), "boilerplate")
    discard(wide, candidates, found)
    return without(docs, removed, text, key)


def contexts(docs: DataFrame, candidates: DataFrame, text: str, site: str, key: str) -> DataFrame:
    """line and context (hash of the nearest lines that are neither blank nor candidates) of each candidate on a site."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, around = [], []
            for hashes, known in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                line = np.array(hashes, np.int64)
                candidate = np.isin(line, known)
                plain = np.append(line[~candidate], 0)  # at -1 and behind the last: none
                place = np.cumsum(~candidate)[candidate]
                lines.append(line[candidate])
                around.append(plain[place - 1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ plain[place].view(np.uint64))
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (lines, around)], ["line", "context"])

    content = F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    rows = docs.where(F.col(site).isNotNull() & F.col(text).isNotNull()).select(place_of(text, key).alias("__place"), F.transform(content, hashed).alias("lines"))
    return rows.join(candidates.hint("merge"), "__place").select("lines", "__hits").mapInArrow(run, "line long, context long")


def place_of(text: str, key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.sha2(text, 256))


def hits(docs: DataFrame, found: DataFrame, text: str, key: str) -> DataFrame:
    """__place and __hits: the lines of ``found`` (line, n) in each text that has any.

    The rows of the lines that hold most of them, at most ``HOT``, are dealt over ``SALTS`` tasks each.
    """
    most = found.agg(F.sum("n")).first()[0] or 0
    hot = [r.line for r in found.where(F.col("n") > most / HOT).select("line").collect()]
    rows = docs.select(place_of(text, key).alias("__place"), F.explode(F.split(F.col(text), "\n")).alias("content")).select("__place", hashed(F.col("content")).alias("line"))
    rows = rows.withColumn("salt", F.when(F.col("line").isin(hot), F.pmod(F.xxhash64("__place"), F.lit(SALTS))).otherwise(0).cast("int"))
    dealt = found.select("line", F.explode(F.when(F.col("line").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return rows.join(dealt, ["line", "salt"], "left_semi").groupBy("__place").agg(F.collect_set("line").alias("__hits"))


def without(docs: DataFrame, hits: DataFrame, text: str, key: str) -> DataFrame:
    """``docs`` without their ``hits``, with n_lines and n_removed."""
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x: (F.trim(x, F.lit(BLANKS)) == "") | ~F.array_contains("__hits", hashed(x)))
    return (
        docs.withColumn("__place", place_of(text, key))
        .join(hits.hint("merge"), "__place", "left")  # one plan at every size
        .withColumn("__kept", F.when(F.col("__hits").isNotNull(), kept).otherwise(lines))
        .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size("__kept")).cast("long"))
        .withColumn(text, F.when(F.col("__hits").isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n")))
        .drop("__place", "__hits", "__kept")
    )


def oracle(min_sites: int = MIN_SITES) -> str:
    """The same by exact counts, in DuckDB's dialect."""
    plain, nearest = "CASE WHEN w.line IS NULL THEN l.line END", "OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
e AS (SELECT row, source, unnest(lines) AS content, unnest(range(1, len(lines) + 1)) AS pos FROM d),
l AS (SELECT row, source, content, pos, trim(content, ' ' || chr(9) || chr(13)) AS line FROM e),
w AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
c AS (SELECT l.line, source, w.line IS NOT NULL AS wide,
      coalesce(last_value({plain} IGNORE NULLS) {nearest} UNBOUNDED PRECEDING AND 1 PRECEDING), '') || chr(10)
      || coalesce(first_value({plain} IGNORE NULLS) {nearest} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS context
      FROM l LEFT JOIN w ON w.line = l.line WHERE l.line <> ''),
b AS (SELECT line FROM c WHERE wide AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT context) >= {min_sites}),
k AS (SELECT row, count(*) AS n_lines, count(b.line) AS n_removed, string_agg(content, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL) AS text
      FROM l LEFT JOIN b USING (line) GROUP BY row)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM d LEFT JOIN k USING (row)"""
