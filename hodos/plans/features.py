"""Training rows and model features, all as columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from hodos.functions.calendar import as_date, greek_holidays, month_number
from hodos.functions.hashing import hash_bucket, row_digest

BASE_COLUMNS = ("device_id", "road_name", "date", "hour")
TARGET = "average_speed"
TIME_FEATURES = ("processed_month", "day_id", "is_weekend", "is_holiday", "is_rush_hour", "hour_sin", "hour_cos")


def recent(mart: DataFrame, as_of: Column | date, days: int) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``; prunes month partitions as well."""
    start = F.date_sub(as_date(as_of), days)
    months = month_number(F.col("processed_year"), F.col("processed_month"))
    return mart.where((F.col("processed_date") >= start) & (months >= month_number(F.year(start), F.month(start))))


def training_rows(mart: DataFrame, as_of: Column | date, lookback_days: int = 365) -> DataFrame:
    """Plausible speeds of the lookback period."""
    speed = F.col(TARGET)
    return recent(mart, as_of, lookback_days).where(speed.isNotNull() & (speed > 2) & (speed < 130)).select(
        "device_id", "road_name", "processed_month", "processed_day", "processed_hour", TARGET, "processed_at", "processed_date"
    )


def base_features(rows: DataFrame, dropped: Observation | None = None) -> DataFrame:
    """The model's raw inputs and target; rows with a null among them are dropped.

    ``dropped`` collects ``n_rows`` and ``n_kept`` while the result is computed.
    """
    hour = F.split("processed_hour", ":")[0].cast("bigint")
    base = rows.select("device_id", "road_name", F.col("processed_at").cast("date").alias("date"), hour.alias("hour"), TARGET)
    columns = [*BASE_COLUMNS, TARGET]
    if dropped is not None:
        complete = F.col(columns[0]).isNotNull()
        for name in columns[1:]:
            complete = complete & F.col(name).isNotNull()
        base = base.observe(dropped, F.count(F.lit(1)).alias("n_rows"), F.count_if(complete).alias("n_kept"))
    return base.na.drop(subset=columns)


def time_features(base: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Calendar features in place of ``date`` and ``hour``.

    The default holiday calendar has at most 2,400 rows, so it is broadcast; a calendar
    handed in is of unknown size and joined as Spark sees fit.
    """
    if holidays is None:
        calendar = F.broadcast(greek_holidays(base.sparkSession).select("holiday_date").distinct())
    else:
        calendar = holidays.select("holiday_date").distinct()
    marked = base.join(calendar, base["date"] == calendar["holiday_date"], "left")
    number = lambda test: test.cast("bigint")
    day_id, hour = F.weekday("date").cast("bigint"), F.col("hour").cast("bigint")
    angle = hour * (F.lit(2.0) * F.pi() / 24)
    rest = [name for name in base.columns if name not in ("date", "hour")]
    return marked.select(
        *rest,
        F.month("date").cast("bigint").alias("processed_month"),
        day_id.alias("day_id"),
        number(day_id >= 5).alias("is_weekend"),
        number(F.col("holiday_date").isNotNull()).alias("is_holiday"),
        number(hour.between(7, 9) | hour.between(15, 18)).alias("is_rush_hour"),
        F.sin(angle).alias("hour_sin"),
        F.cos(angle).alias("hour_cos"),
    )


def row_key() -> list[Column]:
    return [F.col(name) for name in (*BASE_COLUMNS, TARGET)]


def split_marked(base: DataFrame, test_percent: int = 20, seed: int = 42) -> DataFrame:
    """Mark test rows by a hash of the row, the same on every cluster and every retry."""
    return base.withColumn("is_test", hash_bucket(row_digest(*row_key(), seed=seed), 100) < test_percent)


def sample_rows(df: DataFrame, n: int, key: list[Column], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer): the lowest in hash order.

    Sorting out the lowest ``n`` directly would send up to ``n`` rows of every task to one.
    So rows are first counted by the leading 16 bits of the hash, at most 65,536 groups,
    and only rows up to the value that completes ``n`` go on: a little over ``n`` in all.
    Ties in the hash are rows with equal keys.
    """
    marked = df.withColumn("_digest", row_digest(*key, seed=seed)).withColumn("_lead", F.substring("_digest", 1, 4))
    so_far = F.sum("n").over(Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, 0))
    counts = marked.groupBy("_lead").agg(F.count(F.lit(1)).alias("n")).select("_lead", so_far.alias("n"))
    enough = counts.where(F.col("n") >= n).agg(F.coalesce(F.min("_lead"), F.lit("ffff"))).scalar()
    # The hash is a column of its own: a sort key is computed anew in every comparison.
    return marked.where(F.col("_lead") <= enough).orderBy("_digest", *key).limit(n).drop("_digest", "_lead")


def road_devices(base: DataFrame) -> DataFrame:
    """Distinct (road, device) pairs."""
    return base.where(F.col("road_name").isNotNull()).select("road_name", "device_id").distinct()


def road_device_lists(pairs: DataFrame) -> DataFrame:
    """One sorted device list per road; as long as the road has sensors."""
    return pairs.groupBy("road_name").agg(F.sort_array(F.collect_set("device_id")).alias("devices"))
