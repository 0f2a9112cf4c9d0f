"""Categorical encoders as tables: fitted by one aggregation, applied by a join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from hodos.functions.hashing import hash_bucket, row_digest
from hodos.session import cut


@dataclass
class TargetEncoding:
    """Shrunken target mean per category and the value for unseen categories."""

    table: DataFrame  # key, encoding
    default: float | None
    key: str


def _shrunken(n: Column, total: Column, squares: Column, all_n: Column, all_total: Column, all_squares: Column, smoothing: float | None) -> Column:
    """Mean of a category pulled towards the overall mean.

    ``smoothing=m`` weighs the overall mean like m extra rows. ``None`` is the empirical
    Bayes weight: the noisier a category's mean, relative to the overall spread, the
    stronger the pull.
    """
    overall = all_total / all_n
    mean = total / n
    if smoothing is not None:
        blended = (n * mean + F.lit(float(smoothing)) * overall) / (n + F.lit(float(smoothing)))
    else:
        spread = F.greatest(all_squares / all_n - overall * overall, F.lit(0.0))
        inner = F.greatest(squares / n - mean * mean, F.lit(0.0))
        trust = F.when(spread * n + inner > 0, spread * n / (spread * n + inner)).otherwise(F.lit(0.0))
        blended = trust * mean + (F.lit(1.0) - trust) * overall
    return F.when(n > 0, blended).otherwise(overall)


def _moments(target: str) -> list[Column]:
    y = F.col(target).cast("double")
    return [F.count(y).alias("n"), F.sum(y).alias("total"), F.sum(y * y).alias("squares")]


def fit_target_encoding(df: DataFrame, key: str, target: str, smoothing: float | None = None) -> TargetEncoding:
    # One row per category, kept: the rows behind it are read once.
    groups = cut(df.where(F.col(target).isNotNull()).groupBy(key).agg(*_moments(target)))
    n, total, squares = groups.agg(*[F.coalesce(F.sum(s), F.lit(0)) for s in ("n", "total", "squares")]).first()
    encoding = _shrunken(
        F.col("n"), F.col("total"), F.col("squares"), F.lit(n), F.lit(float(total)), F.lit(float(squares)), smoothing
    )
    return TargetEncoding(groups.select(key, encoding.alias("encoding")), total / n if n else None, key)


def apply_target_encoding(df: DataFrame, fitted: TargetEncoding, output: str) -> DataFrame:
    codes = fitted.table.withColumnRenamed("encoding", "_code")
    return (
        df.join(codes, fitted.key, "left")
        .withColumn(output, F.coalesce("_code", F.lit(fitted.default)))
        .drop("_code")
    )


def fold_of(*row_key: Column, folds: int = 5) -> Column:
    return hash_bucket(row_digest(*row_key, seed=5), folds).cast("int")


def cross_fit_target_encoding(df: DataFrame, key: str, target: str, fold: Column, output: str, smoothing: float | None = None) -> DataFrame:
    """Encode training rows with statistics from the other folds only.

    One aggregation by (category, fold) is enough: the statistics of "all other folds"
    are the category's totals minus its own fold.
    """
    marked = df.withColumn("_fold", fold)
    cells = cut(marked.where(F.col(target).isNotNull()).groupBy(key, "_fold").agg(*_moments(target)))
    sums = ("n", "total", "squares")
    per_fold = cells.groupBy("_fold").agg(*[F.sum(s).alias(f"fold_{s}") for s in sums])  # one row per fold
    grand = dict(zip(sums, per_fold.agg(*[F.sum(f"fold_{s}") for s in sums]).first()))
    whole_key = Window.partitionBy(key)  # at most one row per fold
    outside = (
        cells.join(F.broadcast(per_fold), "_fold")
        .select(
            key,
            "_fold",
            *[(F.sum(s).over(whole_key) - F.col(s)).alias(s) for s in sums],
            *[(F.lit(grand[s]) - F.col(f"fold_{s}")).alias(f"all_{s}") for s in sums],
        )
        .select(
            F.col(key).alias("_key"),
            F.col("_fold").alias("_out"),
            _shrunken(*[F.col(s) for s in sums], *[F.col(f"all_{s}") for s in sums], smoothing).alias(output),
        )
    )
    # A null key equals no other key in a join; as a category it still has an encoding.
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_fold") == F.col("_out"))
    return marked.join(outside, same, "left").select(*df.columns, output)


def fit_ordinal_encoding(df: DataFrame, key: str) -> DataFrame:
    """Index of each distinct value in sorted order (key, code).

    Values are sorted into ranges, one per task, and numbered inside each range; the number
    of values in the ranges before is added. The kept ranges make every later read agree on
    where one ends, and no window holds all values.
    """
    values = df.where(F.col(key).isNotNull()).select(key).distinct()
    ranged = cut(values.repartitionByRange(key).select(key, F.spark_partition_id().alias("_range")))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    so_far = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    before = sizes.select("_range", (so_far - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranged.join(F.broadcast(before), "_range").select(key, (F.col("_before") + place - 1).cast("int").alias("code"))


def apply_ordinal_encoding(df: DataFrame, fitted: DataFrame, key: str, output: str, unseen: int = -1) -> DataFrame:
    codes = fitted.select(key, F.col("code").alias("_code"))
    return df.join(codes, key, "left").withColumn(output, F.coalesce("_code", F.lit(unseen))).drop("_code")
