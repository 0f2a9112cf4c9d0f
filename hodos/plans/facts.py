"""Facts: every device at every full hour, with quality flags."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from hodos.functions.calendar import calendar_columns, naive
from hodos.functions.measures import quality_flags
from hodos.operators.gapfill import expand, hourly_spans, joined_spans, on_grid, split_spans, span_hours
from hodos.schemas import FACTS
from hodos.session import shuffle_tasks

KEYS = ["device_id", "processed_at"]
#: Hours a task makes and sorts for a write, about; more hours take more tasks.
TASK_HOURS = 500_000

Moment = Column | datetime


def described(hourly: DataFrame) -> DataFrame:
    """Readings by device and hour with their calendar columns and flags."""
    flags = [rule.alias(name) for name, rule in quality_flags().items()]
    at = F.col("processed_at")
    return hourly.select("device_id", "processed_at", *calendar_columns(at), "ingested_at", "counted_cars", "average_speed", *flags).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in FACTS.fields]
    )


def measurements(staged: DataFrame, devices: DataFrame, first: Moment, last: Moment) -> DataFrame:
    """The dense fact: devices x hours, readings where there are any."""
    return described(expand(hourly_spans(staged, devices, first, last)))


def measurements_in_place(staged: DataFrame, devices: DataFrame, first: Moment, last: Moment) -> DataFrame:
    """The same rows from tables bucketed by device (``sources.bucketed``): nothing is shuffled,
    and the rows stay distributed by device for the join with the roads."""
    return described(expand(joined_spans(staged, devices, first, last)))


def measurements_by_day(staged: DataFrame, devices: DataFrame, first: datetime, last: datetime) -> DataFrame:
    """The same rows, laid out for a write partitioned by day.

    Spans are cut at midnight and gathered by day before they become hours: the exchange
    moves one row per reading and one per silent day, never the dense grid. A day is spread
    over as many tasks as its share of the range, by device, so each task writes about one
    file and all are alike in size: numbered parts of days, as many as ``TASK_HOURS`` asks.
    """
    n_days = (last.date() - first.date()).days + 1
    hours = devices.count() * (n_days * 24)
    tasks = max(shuffle_tasks(staged.sparkSession), -(-hours // TASK_HOURS))
    spans = split_spans(hourly_spans(staged, devices, first, last), "DAY")
    parts = max(1, -(-tasks // max(1, n_days)))
    part = F.pmod(F.xxhash64("device_id"), F.lit(parts)).cast("int")
    number = F.datediff(F.col("first_hour").cast("date"), F.lit(first.date())) * parts + part
    tasks = min(tasks, n_days) if parts == 1 else n_days * parts
    return described(expand(spans.repartitionById(max(1, tasks), F.pmod(number, F.lit(max(1, tasks))))))


def observed_measurements(staged: DataFrame, first: Moment, last: Moment) -> DataFrame:
    """The fact's rows that have a reading.

    Gap rows are never of quality, so everything built on quality rows needs only these
    and skips the dense grid. Assumes the dimension was built from ``staged`` too.
    """
    return described(on_grid(staged, first, last))


def measured_spans(staged: DataFrame, devices: DataFrame, first: Moment, last: Moment) -> DataFrame:
    """The fact in run-length form: a gap is one row per month with its number of hours."""
    spans = split_spans(hourly_spans(staged, devices, first, last), "MONTH")
    counted = spans.withColumn("hours", span_hours()).withColumnRenamed("first_hour", "processed_at")
    return counted.select(
        "device_id",
        F.year("processed_at").alias("processed_year"),
        F.month("processed_at").alias("processed_month"),
        "hours",
        "ingested_at",
        "counted_cars",
        "average_speed",
        *[rule.alias(name) for name, rule in quality_flags().items()],
    )


# --- incremental ---------------------------------------------------------------------


def reprocess_bound(newest: datetime, lookback_days: int = 2) -> datetime:
    """Hours up to and including this one are settled; later ones are built again."""
    return newest - timedelta(days=lookback_days)


def reprocessed_from(bound: datetime, spine_start: datetime) -> datetime:
    """The first hour that is built again."""
    return max(bound.replace(minute=0, second=0, microsecond=0) + timedelta(hours=1), spine_start)


def recent_measurements(staged: DataFrame, devices: DataFrame, bound: datetime, spine_start: datetime, last: datetime, by_day: bool = False) -> DataFrame:
    """The dense fact after ``bound``.

    The bound goes into the range the hours are generated from, and as a filter into the
    scan of the readings: hours that are settled are never generated and their readings
    never read. A reading exactly at the bound has no slot and is left out.
    """
    first = reprocessed_from(bound, spine_start)
    recent = staged.where(F.col("processed_at") >= naive(bound))
    return (measurements_by_day if by_day else measurements)(recent, devices, first, last)


def late_readings(batch: DataFrame, bound: Moment) -> DataFrame:
    """Readings of a batch too old to enter the fact without a full rebuild."""
    return batch.where(F.col("processed_at") <= naive(bound))
