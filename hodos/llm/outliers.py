"""Operator 4: texts whose statistics are multivariate outliers of their language and source.

Five statistics of every text are transformed to be near normal. For each (lang, source) the
minimum-covariance-determinant estimate is sought by concentration steps from a robust start:
the start takes the coordinate-wise medians and deviations; each step keeps the ``HALF`` of the
rows with the least Mahalanobis distances and takes their mean and covariance anew. A last step
re-weights with all rows within the cutoff, and a row is kept if its distance from that estimate
is within the cutoff. Groups are only ever aggregated (sums and mergeable quantile sketches),
never gathered.

Defined results: a null text has no word. A text fails the base rule with fewer than 50 words,
or with more than half of its words in repeated 3-word windows. Texts that fail it are not
learned from. A null language or source is one of its own. A group with fewer than ``LEAST``
passing rows is estimated from those within the cutoff of its language's estimate, as if
``LEAST`` rows of that estimate were among them; a language as small in the same way from all
rows together, and with fewer than ``LEAST`` of all rows nothing is rejected but by the base
rule. Every variance has a floor, so groups that do not vary are well defined. Repeated rows and null ids are kept as they are; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hodos.llm.common import SPACES, table, words
from hodos.session import scratch

SYMBOLS = "#*$%&|<>"
FEATURES = ["f0", "f1", "f2", "f3", "f4"]
P = len(FEATURES)
STEPS, HALF, LEAST = 3, 0.75, 5 * P
#: Fixed values of the chi-square distribution with five degrees of freedom: its quantiles at
#: 0.75 and 0.999, and the factor that makes the covariance of the inner 75 % consistent.
CHI_HALF, CHI_CUT, CONSISTENCY = 6.6257, 20.515, 1.5153
#: Least standard deviation of each transformed statistic: a quarter in log length, 5 % in word
#: length, and shares of 0.25 % symbols, 4 % repeated lines and 2 % repeated words.
FLOORS = [0.25, 0.05, 0.05, 0.20, 0.15]


def _repeated(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are hashed; only where a hash repeats, (hash, place) pairs are sorted, the places
    of equal neighbours taken, and the union of their windows measured in order of place.
    """
    hashes = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def union(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

        covered = F.aggregate(
            F.get(F.transform(F.array(pairs), places), F.lit(0)),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(3))).alias("n"), i.alias("last")),
        )
        return covered["n"]

    once = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), union(h)).otherwise(F.lit(0).cast("long"))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(F.get(F.transform(F.array(hashes), once), F.lit(0)))


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("t"), words(text).alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    rows = rows.select("doc_id", "lang", "source", "t", "w", lines.alias("l"))
    long = lambda c: c.cast("long")
    rows = rows.select(
        "doc_id", "lang", "source", long(F.size("w")).alias("n_words"),
        long(F.length(F.translate("t", SPACES, ""))).alias("word_chars"),
        long(F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        long(_repeated(F.col("w"))).alias("n_repeat_words"), long(F.size("l")).alias("n_lines"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def transformed(rows: DataFrame) -> DataFrame:
    """``rows`` with the transformed statistics FEATURES."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c, of: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(c) / of)))
    return rows.withColumns(
        {
            "f0": F.log1p("n_words"),
            "f1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
            "f2": share("n_symbols", F.greatest(F.col("word_chars"), F.lit(1)).cast("double")),
            "f3": share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1)).cast("double")),
            "f4": share("n_repeat_words", n),
        }
    )


def _inverse(matrix: Column) -> Column:
    """Minus the inverse of a positive definite array of rows: every place swept once."""

    def sweep(m: Column, k: Column) -> Column:
        pivot = F.greatest(F.get(F.get(m, k), k), F.lit(1e-12))
        along = lambda row, i, j: F.when(i == k, F.when(j == k, -1 / pivot).otherwise(F.get(F.get(m, k), j) / pivot)).otherwise(
            F.when(j == k, F.get(row, k) / pivot).otherwise(F.get(row, j) - F.get(row, k) * F.get(F.get(m, k), j) / pivot)
        )
        return F.transform(m, lambda row, i: F.transform(row, lambda _, j: along(row, i, j)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(P - 1)), matrix, sweep)


def _estimate(groups: DataFrame, means: list[Column], cov) -> DataFrame:
    """(g, mean, swept) of each row of ``groups``; ``cov(i, j)`` is the covariance for i >= j."""
    matrix = F.array(*[F.array(*[cov(max(i, j), min(i, j)) for j in range(P)]) for i in range(P)])
    return groups.select("g", F.array(*means).alias("mean"), matrix.alias("cov"), _inverse(matrix).alias("swept"))


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    """The estimate of each group ``g`` from its mean and floored covariance times ``factor``."""
    means = [F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]
    covs = [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"v{i}{j}") for i in range(P) for j in range(i + 1)]
    floor = lambda i, j: F.lit(FLOORS[i] ** 2 if i == j else 0.0)
    return _estimate(rows.groupBy("g").agg(*means, *covs), [F.col(f"m{i}") for i in range(P)], lambda i, j: F.col(f"v{i}{j}") * factor + floor(i, j))


def _shrunk(rows: DataFrame, parents: DataFrame, family: DataFrame) -> DataFrame:
    """The estimate of each ``g`` of ``family`` (g, parent) from its parent's and its own ``rows`` within the cutoff of that."""
    means = [F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]
    covs = [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"v{i}{j}") for i in range(P) for j in range(i + 1)]
    above = family.join(parents.withColumnRenamed("g", "parent"), "parent")
    inner = _measured(rows.join(family.select("g"), "g", "left_semi"), above).filter(F.col("d2") <= CHI_CUT)
    own = inner.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *means, *covs)
    met = above.join(own, "g", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole, m = F.col("n") + LEAST, lambda i: F.coalesce(f"m{i}", F.get("mean", F.lit(i)))
    off = lambda i: m(i) - F.get("mean", F.lit(i))
    mean = [(F.col("n") * m(i) + LEAST * F.get("mean", F.lit(i))) / whole for i in range(P)]
    up = lambda i, j: F.get(F.get("cov", F.lit(i)), F.lit(j))
    return _estimate(met, mean, lambda i, j: (F.col("n") * F.coalesce(f"v{i}{j}", F.lit(0.0)) + LEAST * up(i, j)) / whole + F.col("n") * LEAST * off(i) * off(j) / (whole * whole))


def _start(rows: DataFrame) -> DataFrame:
    """The estimate of each group from medians and quartiles, without correlation."""
    found = rows.groupBy("g").agg(*[F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, f in enumerate(FEATURES)])
    at = lambda i, k: F.get(f"q{i}", F.lit(k))
    variance = lambda i: F.pow((at(i, 2) - at(i, 0)) / 1.349, F.lit(2)) + FLOORS[i] ** 2
    return _estimate(found, [at(i, 1) for i in range(P)], lambda i, j: variance(i) if i == j else F.lit(0.0))


def _measured(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """``rows`` with ``d2``, the squared distance from their group's estimate (null without one)."""
    met = rows.join(estimate, "g", "left")
    off = [F.col(f) - F.get("mean", F.lit(i)) for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i + 1):
            total = total - F.get(F.get("swept", F.lit(i)), F.lit(j)) * off[i] * off[j] * (1.0 if i == j else 2.0)
    return met.select(*rows.columns, total.alias("d2"))


def judged(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` (with FEATURES, base_failed, lang, source) and ``d2``."""
    spark = rows.sparkSession
    language = [F.col("lang").isNull(), F.col("lang")]
    rows = rows.withColumns({"g": F.xxhash64(F.lit(2), *language, F.col("source").isNull(), "source"), "l": F.xxhash64(F.lit(1), *language)})
    small, everything = F.col("n") < LEAST, F.lit(0).cast("long")
    rows.filter(~F.col("base_failed")).groupBy("g", "l").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    # a language is estimated where one of its groups is small, all rows where such a language is
    groups.groupBy("l").agg(F.sum("n").alias("n"), F.max(small).alias("asked")).filter("asked").write.parquet(f"{folder}/languages")
    languages = spark.read.parquet(f"{folder}/languages")
    last_resort = not languages.filter(small).isEmpty()
    own = groups.join(languages.select("l", (~small).alias("with_l")), "l", "left")
    pools = F.array(F.when(~small, F.col("g")), F.when(F.col("with_l"), F.col("l")), F.when(F.lit(last_resort), everything))
    rows.join(own.select("g", F.array_compact(pools).alias("pools")), "g", "left").write.parquet(f"{folder}/named")
    named = spark.read.parquet(f"{folder}/named")
    all_passing = named.filter(~F.col("base_failed"))
    passing = all_passing.select(F.explode("pools").alias("g"), *FEATURES)
    big = passing.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST).select("g")

    def stored(estimate: DataFrame, step: str) -> DataFrame:
        estimate.join(big, "g", "left_semi").write.parquet(f"{folder}/{step}")
        return spark.read.parquet(f"{folder}/{step}")

    estimate = stored(_start(passing), "start")
    for step in range(STEPS):
        measured = _measured(passing, estimate)
        limits = measured.groupBy("g").agg(F.percentile_approx("d2", HALF, 1000).alias("limit"))
        inner = measured.join(limits, "g").filter(F.col("d2") <= F.col("limit"))
        estimate = stored(_moments(inner, CONSISTENCY), f"step{step}")
    inner = _measured(passing, estimate).filter(F.col("d2") <= CHI_CUT)
    estimate = stored(_moments(inner, 1.0), "last")

    def with_small(estimate: DataFrame, rows: DataFrame, family: DataFrame, step: str) -> DataFrame:
        _shrunk(rows, estimate, family).write.parquet(f"{folder}/{step}")
        return estimate.unionByName(spark.read.parquet(f"{folder}/{step}"))

    if last_resort:
        family = languages.filter(small).select(F.col("l").alias("g"), everything.alias("parent"))
        estimate = with_small(estimate, all_passing.select(F.col("l").alias("g"), *FEATURES), family, "small_languages")
    if not languages.isEmpty():
        family = groups.filter(small).select("g", F.col("l").alias("parent"))
        estimate = with_small(estimate, all_passing.select("g", *FEATURES), family, "small_groups")
    return _measured(named, estimate)


def kept_rows(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, d2 and kept of every row."""
    spark = documents.sparkSession
    folder = scratch(spark, "outliers")
    statistics(documents).write.parquet(f"{folder}/statistics")
    transformed(spark.read.parquet(f"{folder}/statistics")).write.parquet(f"{folder}/transformed")
    out = judged(spark.read.parquet(f"{folder}/transformed"), folder)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CHI_CUT))


def quality_rules(spark, sf_dir: str) -> DataFrame:
    """op4: the statistics and the verdict for every row of ``documents``."""
    out = kept_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
