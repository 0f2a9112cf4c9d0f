"""Operator 7: lines that spread over many sites, counted by HyperLogLog sketches, removed.

The lines of all texts are counted by their 128-bit hash. A line seen on a single site drops out
by the smallest and largest site alone; for all others a sketch of their sites is merged by
aggregation. Lines whose estimate is within ``NEAR`` of ``SPREAD`` get an exact count of distinct
sites. Lines on ``SPREAD`` sites or more are boilerplate and removed wherever they stand.

Defined results: a site is a row's source; a null source is no site, and its lines are removed
like others. Lines are split at \\n and compared without outer white space; blank lines are
never removed. Null texts stay null. Rows that agree in id and text are treated alike; null ids
are kept. Further columns pass through; one called n_lines or n_removed is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hodos.llm.common import SPACES, free, table
from hodos.session import scratch

SPREAD, NEAR, PRECISION = 5, 0.25, 12
#: Boilerplate lines that are broadcast, 16 bytes each; tasks a line is dealt to beyond that.
BROADCAST_LINES, SALT = 200_000, 32


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _lines(documents: DataFrame) -> DataFrame:
    """doc_id, copy, site, place, a, b: every line with a word; (a, b) is its 128-bit hash."""
    text = F.col("text").cast("string")
    rows = documents.select("doc_id", F.xxhash64("text").alias("copy"), F.col("source").cast("string").alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))
    rows = rows.withColumn("line", _bare(F.col("line"))).filter("line <> ''")
    return rows.select("doc_id", "copy", "site", "place", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), F.col("line")).alias("b"))


def boilerplate(documents: DataFrame) -> DataFrame:
    """(a, b, sites): the lines on ``SPREAD`` sites or more; sites is exact near the limit, else
    the sketch's estimate."""
    folder = scratch(documents.sparkSession, "spread")
    lines, site = _lines(documents).filter("site is not null"), F.xxhash64("site")
    seen = lines.groupBy("a", "b").agg(F.min(site).alias("low"), F.max(site).alias("high"))
    several = seen.filter("low <> high").select("a", "b")
    # each line once a site: a line in a third of all texts is no more rows than there are sites
    lines.select("a", "b", "site").distinct().join(several, ["a", "b"]).write.parquet(f"{folder}/several")
    several = documents.sparkSession.read.parquet(f"{folder}/several")
    sketched = several.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", PRECISION)).alias("estimate"))
    sketched.write.parquet(f"{folder}/sketched")
    sketched = documents.sparkSession.read.parquet(f"{folder}/sketched")
    near = sketched.filter(F.abs(F.col("estimate") - SPREAD) <= NEAR * SPREAD).select("a", "b")
    exact = several.join(near, ["a", "b"], "left_semi").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("sites"))
    sure = sketched.filter(F.col("estimate") > SPREAD * (1 + NEAR)).select("a", "b", F.col("estimate").alias("sites"))
    return sure.unionByName(exact.filter(F.col("sites") >= SPREAD))


def cleaned(documents: DataFrame) -> DataFrame:
    """``documents`` without boilerplate lines, with n_lines (with a word) and n_removed."""
    hits = _hits(documents)
    places = hits.groupBy("doc_id", "copy").agg(F.collect_set("place").alias("places"))
    copy, out = free("copy", documents.columns), free("hit_places", documents.columns)
    places = places.select(F.col("doc_id").alias("hit_id"), F.col("copy").alias("hit_copy"), F.col("places").alias(out))
    rows = documents.withColumn(copy, F.xxhash64("text"))
    met = rows.join(places, rows.doc_id.eqNullSafe(places.hit_id) & (rows[copy] == places.hit_copy), "left")
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    worded = F.size(F.filter(lines, lambda x: _bare(x) != ""))
    kept = F.when(F.col(out).isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(out, i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(worded).cast("long")
    n_removed = F.when(F.col(out).isNull(), F.lit(0)).otherwise(F.size(out)).cast("long")
    return met.select(*[rows[c] for c in documents.columns if c not in ("text", "n_lines", "n_removed")], n_lines.alias("n_lines"), n_removed.alias("n_removed"), kept.alias("text"))


def _hits(documents: DataFrame) -> DataFrame:
    """Where boilerplate lines stand. The lines come to the texts while they are at most
    ``BROADCAST_LINES``; beyond that texts and lines are dealt to ``SALT`` tasks a line."""
    folder, lines = scratch(documents.sparkSession, "boilerplate"), _lines(documents)
    boilerplate(documents).select("a", "b").write.parquet(folder)
    bad = documents.sparkSession.read.parquet(folder)
    if bad.count() <= BROADCAST_LINES:
        return lines.join(F.broadcast(bad), ["a", "b"])
    bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "copy", "place"), F.lit(SALT)).cast("int")).join(bad, ["a", "b", "salt"])


def line_dedup(spark, sf_dir: str) -> DataFrame:
    """op7: doc_id, n_lines, n_removed, kept_chars, kept_md5 of every row of ``documents``."""
    out = cleaned(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


SQL = r"""
WITH l AS (SELECT doc_id, source, place, lines[place] AS line, trim(lines[place], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS place FROM documents)),
bad AS (SELECT bare FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 5),
marked AS (SELECT l.*, bad.bare IS NOT NULL AS out FROM l LEFT JOIN bad USING (bare)),
whole AS (SELECT doc_id, count(*) FILTER (WHERE bare <> '') AS n_lines, count(*) FILTER (WHERE out) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT out), '') AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(kept) AS kept_chars, md5(kept) AS kept_md5 FROM whole
"""
