"""Operator 9: sources mixed to target weights by cutting a random order at exact budgets.

Every row gets a hash-random key of its id and text. Equal rows are counted first. Within a
source the rows are ordered by key and their sizes summed up: the key space is cut into equal
ranges, each (source, range) is ordered on its own, and the sums of the ranges before it are
added. The mix takes whole epochs of a source as often as its budget holds them, and of one more
epoch the rows up to where the budget ends; the row it ends in is taken in part.

Defined results: a null text has size 0; sources are ordered by code point with null last, a null
source being a source of its own; sources without a word have target 0. Repeated rows follow
each other in the order and are taken like different ones. Sources are weighed in one window over
the table of sources, one row each; documents never meet in one. ``selected`` returns the given
columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hodos.llm.common import table, words
from hodos.session import scratch

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Rows of one (source, range) that are ordered together, about.
RANGE_ROWS = 8_192


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with ``target``: shares of SHARE times all sizes by weight, none
    above MOST times its source's size, what is over shared again by weight.

    Sources reach their limit in the order of limit over weight. For each number of sources at
    their limit the rest share what is left; the first number that lets no further source
    exceed its limit is the answer.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(ordered) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int")).cast("double")
    limit = (F.col("source_size") * MOST).cast("double")
    weighed = sizes.withColumn("place", place).withColumn("weight", weight).withColumn("limit", limit).withColumn("reach", F.col("limit") / F.col("weight"))
    whole = Window.partitionBy()
    before = Window.orderBy("reach", "place").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("reach", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = SHARE * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    levelled = weighed.withColumn("level", left / F.sum("weight").over(after))
    level = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "place", "level"))).over(whole)["level"]
    target = F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))
    return levelled.withColumn("target", F.round(target, 4)).select("source", "source_size", "target")


def _units(documents: DataFrame, others: list[str]) -> DataFrame:
    """Rows that agree in id, text, source and the columns ``others``, as one row for each task
    that read some: mark, split, doc_id, source, size, key and copies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")))
    rows = documents.select(
        "doc_id", "source", size_of(text).alias("size"), F.conv(F.substring(F.md5(told.cast("binary")), 1, 15), 16, 10).cast("long").alias("key"),
        _mark(others).alias("mark"), F.spark_partition_id().alias("split"),
    )
    return rows.groupBy("mark", "split", "doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("copies"))


def _mark(others: list[str]) -> Column:
    """A name of a row by its contents."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("doc_id", "source")]
    rest = [F.xxhash64(*[F.col(f"`{c}`") for c in others]).cast("string")] if others else []
    return F.concat_ws(":", text, *rest, *named)


def mixed(documents: DataFrame) -> DataFrame:
    """``documents`` with size, source_size, target and taken (words, repeats counted)."""
    placed = _placed(documents.sparkSession, _units(documents, []))
    # copies are dealt out again before they become rows, as one unit may stand for very many
    each = placed.repartition("mark", "split").select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - (F.col("copy") - 1) * F.col("size")))
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def _placed(spark, units: DataFrame) -> DataFrame:
    """``units`` with source_size, target, epochs (taken of every row) and rest: the words of one
    more epoch that are left when the unit's first copy comes."""
    folder = scratch(spark, "mix")
    units.write.parquet(f"{folder}/sizes")
    units = spark.read.parquet(f"{folder}/sizes")
    ranges = max(1, -(-units.count() // RANGE_ROWS))
    wide = -(-(1 << 60) // ranges)
    ranged = units.withColumn("range", F.floor(F.col("key") / wide)).withColumn("words", F.col("size") * F.col("copies"))
    sums = ranged.groupBy("source", "range").agg(F.sum("words").alias("range_size"))
    sums.write.parquet(f"{folder}/sums")
    sums = spark.read.parquet(f"{folder}/sums")
    goals = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    same = offsets.source.eqNullSafe(goals.source)
    plan = offsets.join(goals, same).select(offsets.source.alias("p_source"), F.col("range").alias("p_range"), "offset", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "size", "mark", "split").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("before", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    placed = summed.join(plan, summed.source.eqNullSafe(plan.p_source) & (summed.range == plan.p_range))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.greatest(F.lit(0), budget - epochs * F.col("source_size") - F.col("offset") - F.col("before"))
    return placed.select("mark", "split", "doc_id", "source", "size", "copies", "source_size", "target", epochs.alias("epochs"), rest.alias("rest"))


def selected(documents: DataFrame) -> DataFrame:
    """``documents`` as mixed: each row once for every epoch in which words of it are taken; the
    row in which a budget ends is kept whole in that epoch.

    Equal rows come together in the order, so all of them are taken equally often, but for those
    of the one unit a source's budget ends in: its further rows are made from one of them.
    """
    spark = documents.sparkSession
    others = [c for c in documents.columns if c not in ("doc_id", "text", "source")]
    folder = scratch(spark, "selected")
    more = F.least(F.col("copies"), F.when(F.col("size") > 0, F.ceil(F.col("rest") / F.col("size"))).otherwise(F.lit(0)))
    units = _placed(spark, _units(documents, others)).filter("size > 0")
    units.groupBy("mark").agg(F.first("epochs").alias("epochs"), F.sum("copies").alias("copies"), F.sum(more).alias("more")).write.parquet(f"{folder}/units")
    units = spark.read.parquet(f"{folder}/units").withColumn("all", (F.col("more") == F.col("copies")).cast("int"))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), _mark(others).alias("mark"))
    even = rows.join(units.select("mark", (F.col("epochs") + F.col("all")).alias("times")).filter("times > 0"), "mark")
    odd = rows.join(units.filter("all = 0 and more > 0").select("mark", F.col("more").alias("times")), "mark").groupBy("mark").agg(F.first("row").alias("row"), F.first("times").alias("times"))
    both = even.select("row", "times").unionByName(odd.select("row", "times"))
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def mix(spark, sf_dir: str) -> DataFrame:
    """op9: doc_id, size, source_size, target, taken for every row of ``documents``."""
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS key FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sized GROUP BY source),
levels AS (
  SELECT *, 2.0 * source_size AS cap,
    (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM sources),
goals AS (
  SELECT source, source_size, CAST(round(least(cap, weight * coalesce((SELECT min(level) FROM levels l WHERE l.level <= l.cap / l.weight
      AND NOT EXISTS (SELECT 1 FROM levels e WHERE e.level <= e.cap / e.weight AND e.cap / e.weight < l.cap / l.weight)), 1e300)), 4) AS DOUBLE) AS target FROM levels),
ordered AS (
  SELECT s.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE
  (budget // source_size) * size + least(size, greatest(0, budget % source_size - before)) END AS BIGINT) AS taken FROM ordered
"""
