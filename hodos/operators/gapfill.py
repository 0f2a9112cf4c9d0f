"""Dense hourly series per device without building devices x hours first.

The obvious plan - cross join the devices with the hour spine, then left join the
readings - shuffles the whole dense grid. Here only the readings are shuffled, by device.
Each reading looks at its successor, which gives the gap behind it as one
``[first_hour, last_hour]`` span; a marker row in front of the range does the same for the
time before the first reading and for silent devices. Spans become hours at the very end,
by a generator that needs no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hodos.functions.calendar import full_hour, hours, naive
from hodos.session import shuffle_tasks

MEASURES = ("ingested_at", "counted_cars", "average_speed")


def on_grid(readings: DataFrame, first: Column, last: Column) -> DataFrame:
    """The readings a spine of full hours from ``first`` to ``last`` can match."""
    at = F.col("processed_at")
    return readings.where(
        F.col("device_id").isNotNull() & at.between(naive(first), naive(last)) & (at == full_hour(at))
    ).select("device_id", "processed_at", *MEASURES)


def hourly_spans(readings: DataFrame, devices: DataFrame, first: Column, last: Column) -> DataFrame:
    """Readings and the gaps between them, one row each.

    ``readings`` is unique on (device_id, processed_at) and ``devices`` on device_id; both
    bounds are full hours. Columns: device_id, first_hour, last_hour and the measures,
    which are null for a gap. A window partition never exceeds the number of hours.
    """
    first, last = naive(first), naive(last)
    found = on_grid(readings, first, last).withColumn("is_marker", F.lit(False))
    types = dict(found.dtypes)
    markers = devices.select(
        "device_id",
        (first - hours(1)).alias("processed_at"),
        *[F.lit(None).cast(types[name]).alias(name) for name in MEASURES],
        F.lit(True).alias("is_marker"),
    )
    by_device = Window.partitionBy("device_id").orderBy("processed_at")
    following = F.lead("processed_at").over(by_device)
    # A few readings may stand for many hours, so shuffled bytes say little about the work
    # ahead: a fixed number of tasks keeps AQE from merging them by size.
    spread = found.unionByName(markers).repartition(shuffle_tasks(readings.sparkSession), "device_id")
    chained = (
        spread
        .withColumn("gap_end", F.coalesce(following, last + hours(1)) - hours(1))
        # The marker sorts first: without one the device is not in the dimension.
        .withColumn("known", F.first("is_marker").over(by_device))
        .where("known")
    )
    gap_start = F.col("processed_at") + hours(1)
    reading = F.struct(
        F.col("processed_at").alias("first_hour"),
        F.col("processed_at").alias("last_hour"),
        *[F.col(name) for name in MEASURES],
    )
    gap = F.struct(
        gap_start.alias("first_hour"),
        F.col("gap_end").alias("last_hour"),
        *[F.lit(None).cast(types[name]).alias(name) for name in MEASURES],
    )
    # Nulls are filtered after the generator: a lambda would leave generated code.
    pieces = F.array(F.when(~F.col("is_marker"), reading), F.when(gap_start <= F.col("gap_end"), gap))
    return chained.select("device_id", F.explode(pieces).alias("s")).where("s IS NOT NULL").select("device_id", "s.*")


def joined_spans(readings: DataFrame, devices: DataFrame, first: Column, last: Column) -> DataFrame:
    """The rows of ``hourly_spans`` from a join by device, for tables bucketed by device.

    Devices and readings already lie together then, and neither the join nor the window behind
    it has an exchange; marker rows and a fixed number of tasks, which both cost one, are left
    out. Over other tables the result is the same and Spark shuffles the readings.
    """
    first, last = naive(first), naive(last)
    rows = devices.select("device_id").join(on_grid(readings, first, last), "device_id", "left")
    types, at = dict(rows.dtypes), F.col("processed_at")
    by_device = Window.partitionBy("device_id").orderBy("processed_at")
    ordered = rows.withColumn("before", F.lag("processed_at").over(by_device)).withColumn("after", F.lead("processed_at").over(by_device))

    def span(start: Column, end: Column, measured: bool) -> Column:
        measures = [(F.col(name) if measured else F.lit(None).cast(types[name])).alias(name) for name in MEASURES]
        return F.struct(start.alias("first_hour"), end.alias("last_hour"), *measures)

    # A device's first row also stands for the hours in front of it, which are all hours of a silent device.
    head_end = F.coalesce(at, last + hours(1)) - hours(1)
    gap_start, gap_end = at + hours(1), F.coalesce("after", last + hours(1)) - hours(1)
    pieces = F.array(
        F.when(F.col("before").isNull() & (first <= head_end), span(first, head_end, False)),
        F.when(at.isNotNull(), span(at, at, True)),
        F.when(gap_start <= gap_end, span(gap_start, gap_end, False)),
    )
    return ordered.select("device_id", F.explode(pieces).alias("s")).where("s IS NOT NULL").select("device_id", "s.*")


def split_spans(spans: DataFrame, unit: str) -> DataFrame:
    """Cut spans at the ends of calendar units, ``MONTH`` or ``DAY``."""
    step = F.expr(f"INTERVAL 1 {unit}")
    unit_of = (lambda name: F.trunc(name, "MM")) if unit == "MONTH" else (lambda name: F.col(name).cast("date"))
    start = F.col("unit_start").cast("timestamp_ntz")
    rest = [name for name in spans.columns if name not in ("first_hour", "last_hour")]
    units = F.sequence(unit_of("first_hour"), unit_of("last_hour"), step)
    return spans.withColumn("unit_start", F.explode(units)).select(
        *rest,
        F.greatest(F.col("first_hour"), start).alias("first_hour"),
        F.least(F.col("last_hour"), start + step - hours(1)).alias("last_hour"),
    )


def span_hours() -> Column:
    """Number of hourly slots in a span."""
    return F.timestamp_diff("HOUR", F.col("first_hour"), F.col("last_hour")) + 1


def expand(spans: DataFrame) -> DataFrame:
    """One row per hour; no exchange."""
    rest = [name for name in spans.columns if name not in ("first_hour", "last_hour", "device_id")]
    slots = F.sequence("first_hour", "last_hour", hours(1))
    return spans.select("device_id", F.explode(slots).alias("processed_at"), *rest)
