"""Reports over a window of the gold table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hodos.functions.measures import speed_volume, weighted_speed

KPI_COLUMNS = ("weighted_avg_speed", "sum_counted_cars", "distinct_roads_count", "distinct_devices_count")


def kpi(window: DataFrame, with_time: bool = True) -> DataFrame:
    """Headline figures, one row.

    Aggregated per (road, device) first: two distinct counts over raw rows would copy
    every row for each of them, here they see one row per device.
    """
    per_device = window.groupBy("road_name", "device_id").agg(
        F.sum(speed_volume()).alias("speed_cars"),
        F.sum("counted_cars").alias("cars"),
        F.max("processed_at").alias("latest"),
    )
    figures = [
        (F.sum("speed_cars") / F.nullif(F.sum("cars"), F.lit(0))).alias("weighted_avg_speed"),
        F.sum("cars").alias("sum_counted_cars"),
        F.countDistinct("road_name").alias("distinct_roads_count"),
        F.countDistinct("device_id").alias("distinct_devices_count"),
    ]
    if with_time:
        figures.append(F.max("latest").alias("latest_timestamp"))
    return per_device.agg(*figures)


def period_totals(tagged: DataFrame) -> DataFrame:
    """Sums per (period, road, device) and per (period, weekly slot), from one pass.

    Grouping sets let one aggregation serve the headline figures and the busiest slots;
    ``by_slot`` is 1 for the rows of slots.
    """
    device, slot = ["period", "road_name", "device_id"], ["period", "processed_day", "processed_hour"]
    return tagged.groupingSets([device, slot], *device, *slot[1:]).agg(
        F.grouping("road_name").alias("by_slot"),
        F.sum(speed_volume()).alias("speed_cars"),
        F.sum("counted_cars").alias("cars"),
        F.max("processed_at").alias("latest"),
    )


def _speed() -> Column:
    return F.col("speed_cars") / F.nullif(F.col("cars"), F.lit(0))


def period_figures(totals: DataFrame) -> DataFrame:
    """The figures of :func:`kpi`, one row per period."""
    figures = totals.where("by_slot = 0").groupBy("period").agg(
        F.sum("speed_cars").alias("speed_cars"),
        F.sum("cars").alias("cars"),
        F.countDistinct("road_name").alias("distinct_roads_count"),
        F.countDistinct("device_id").alias("distinct_devices_count"),
        F.max("latest").alias("latest_timestamp"),
    )
    return figures.withColumn("weighted_avg_speed", _speed()).withColumnRenamed("cars", "sum_counted_cars").drop("speed_cars")


def delta_of(figures: DataFrame, with_time: bool = False) -> DataFrame:
    """Both periods' figures and their differences, one row."""

    def of(period: str, name: str) -> Column:
        value = F.max(F.when(F.col("period") == period, F.col(name)))
        return F.coalesce(value, F.lit(0)) if name.startswith("distinct") else value

    times = [of("last", "latest_timestamp").alias("latest_timestamp")] if with_time else []
    both = figures.agg(
        *[of("last", name).alias(name) for name in KPI_COLUMNS],
        *[of("previous", name).alias(f"previous_{name}") for name in KPI_COLUMNS],
        *times,
    )
    return both.select("*", *[(F.col(name) - F.col(f"previous_{name}")).alias(f"delta_{name}") for name in KPI_COLUMNS])


def kpi_delta(last: DataFrame, previous: DataFrame) -> DataFrame:
    """:func:`delta_of` two reports of :func:`kpi` that exist already, one row each."""
    named = lambda df, period: df.select(F.lit(period).alias("period"), *KPI_COLUMNS)
    return delta_of(named(last, "last").unionByName(named(previous, "previous")))


def slots_of(totals: DataFrame) -> DataFrame:
    """:func:`speed_by_slot` of the last period, from the totals."""
    slots = totals.where("by_slot = 1 AND period = 'last'")
    return slots.select("processed_day", "processed_hour", _speed().alias("weighted_avg_speed"))


def daily_speed_count(window: DataFrame) -> DataFrame:
    return window.groupBy("processed_date").agg(
        F.sum("counted_cars").alias("total_counted_cars"), weighted_speed().alias("weighted_avg_speed")
    )


def speed_by_slot(window: DataFrame) -> DataFrame:
    """Weighted speed per weekday and hour: at most 7 x 24 rows."""
    return window.groupBy("processed_day", "processed_hour").agg(weighted_speed().alias("weighted_avg_speed"))


def extreme_slots(slots: DataFrame) -> DataFrame:
    """The slots with the lowest and the highest weighted speed, ties included.

    The comparison uses the very values the extremes were taken from; a join against a
    second aggregation could miss by a rounding error. The window spans the weekly slots
    only.
    """
    everything = Window.partitionBy()
    speed = F.col("weighted_avg_speed")
    marked = slots.select("*", F.min(speed).over(everything).alias("slowest"), F.max(speed).over(everything).alias("fastest"))
    return marked.where((speed == F.col("slowest")) | (speed == F.col("fastest")))


def busiest_times(window: DataFrame) -> DataFrame:
    return extreme_slots(speed_by_slot(window)).select("processed_day", "processed_hour", "weighted_avg_speed")


def labelled_slots(slots: DataFrame) -> DataFrame:
    """Extremes with a label: slow traffic marks the busiest slot."""
    label = F.when(F.col("weighted_avg_speed") == F.col("slowest"), "busiest").otherwise("lightest")
    return extreme_slots(slots).select("processed_day", "processed_hour", "weighted_avg_speed", label.alias("slot"))


def labelled_times(window: DataFrame) -> DataFrame:
    return labelled_slots(speed_by_slot(window))
