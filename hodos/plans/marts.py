"""Gold tables and the date windows reports look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hodos.functions.calendar import month_number
from hodos.functions.measures import share
from hodos.schemas import MART_COLUMNS


def traffic_road(facts: DataFrame, roads: DataFrame) -> DataFrame:
    """Quality readings with their road; a device without a road keeps its readings.

    No broadcast hint: the dimension grows with the network, so Spark decides by its
    measured size. Beyond that both sides are shuffled by device, unless they are bucketed by it
    (``sources.bucketed``).
    """
    quality = facts.where("is_quality")
    return quality.join(roads.select("device_id", "road_name"), "device_id", "left").select(*MART_COLUMNS)


def laid_out(mart: DataFrame) -> DataFrame:
    """Rows in (time, road) order for a write: ranges over tasks, sorted inside each."""
    return mart.repartitionByRange("processed_at", "road_name").sortWithinPartitions("processed_at", "road_name")


def latest_date(mart: DataFrame) -> Column:
    """Date of the newest row, as a scalar subquery evaluated once.

    The newest month comes first: over partition columns Spark answers that from few bytes of
    each file, and the date is then looked up in that month's files alone.
    """
    months = month_number(F.col("processed_year"), F.col("processed_month"))
    newest = mart.agg(F.max(months)).scalar()
    return mart.where(months == newest).agg(F.max("processed_date")).scalar()


def since(mart: DataFrame, day: Column, before: Column | None = None) -> DataFrame:
    """Rows of ``day`` and later, up to the day ``before`` another. The month tests are implied;
    they prune partitions."""
    months = month_number(F.col("processed_year"), F.col("processed_month"))
    rows = mart.where((F.col("processed_date") >= day) & (months >= month_number(F.year(day), F.month(day))))
    if before is None:
        return rows
    return rows.where((F.col("processed_date") < before) & (months <= month_number(F.year(before), F.month(before))))


def last_days(mart: DataFrame, days: int = 30) -> DataFrame:
    """The newest date and the ``days`` dates before it."""
    return since(mart, F.date_sub(latest_date(mart), days))


def previous_days(mart: DataFrame, days: int = 30) -> DataFrame:
    """The ``days`` dates in front of :func:`last_days`."""
    latest = latest_date(mart)
    start, end = F.date_sub(latest, 2 * days), F.date_sub(latest, days)
    at = F.col("processed_at")
    return since(mart, start, end).where((at >= start.cast("timestamp_ntz")) & (at < end.cast("timestamp_ntz")))


def both_periods(mart: DataFrame, days: int = 30) -> DataFrame:
    """Rows of :func:`last_days` and :func:`previous_days` in one scan, told apart by ``period``."""
    latest = latest_date(mart)
    start, end = F.date_sub(latest, 2 * days), F.date_sub(latest, days)
    at = F.col("processed_at")
    earlier = (at >= start.cast("timestamp_ntz")) & (at < end.cast("timestamp_ntz"))
    period = F.when(F.col("processed_date") >= end, "last").when(earlier, "previous")
    return since(mart, start).withColumn("period", period).where("period IS NOT NULL")


def device_health(facts: DataFrame, weight: str | None = None) -> DataFrame:
    """Counts and percentages of bad readings per month.

    ``weight`` names a column with the number of readings a row stands for (run-length
    facts); without it every row is one reading.
    """
    one = F.lit(1) if weight is None else F.col(weight)
    flags = {
        "dead": "is_dead",
        "ghost": "is_ghost_reading",
        "impossible_speed": "is_impossible_speed",
        "missing_reading": "is_missing",
    }
    counts = facts.groupBy("processed_year", "processed_month").agg(
        F.sum(one).cast("bigint").alias("readings"),
        *[F.sum(F.when(F.col(flag), one).otherwise(0)).cast("bigint").alias(f"{name}_count") for name, flag in flags.items()],
    )
    return with_shares(counts)


def with_shares(counts: DataFrame) -> DataFrame:
    """The counts of :func:`device_health` with their percentages of all readings."""
    columns = ["processed_year", "processed_month", "readings"]
    for name in ("dead", "ghost", "impossible_speed", "missing_reading"):
        columns += [F.col(f"{name}_count"), share(F.col(f"{name}_count"), F.col("readings")).alias(f"{name}_percent")]
    return counts.select(*columns)


def by_month(health: DataFrame) -> DataFrame:
    return health.orderBy("processed_year", "processed_month")
