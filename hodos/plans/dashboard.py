"""Queries and chart data behind the dashboard pages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from hodos.functions.calendar import DAYS, day_rank, month_start
from hodos.functions.measures import weighted_speed
from hodos.plans.reporting import labelled_slots


def heatmap(window: DataFrame) -> DataFrame:
    return window.groupBy("processed_hour", "processed_day").agg(weighted_speed().alias("weighted_avg_speed"))


def spatiotemporal(mart: DataFrame) -> DataFrame:
    """Speed and cars per road and weekly slot, in order of road, weekday name and hour."""
    slots = mart.groupBy("road_name", "processed_hour", "processed_day").agg(
        weighted_speed().alias("weighted_avg_speed"), F.avg("counted_cars").alias("avg_counted_cars")
    )
    return slots.orderBy(F.col("road_name").asc_nulls_last(), "processed_day", "processed_hour")


def speed_count(mart: DataFrame) -> DataFrame:
    """Speed and cars per road and hour, in that order."""
    hourly = mart.groupBy("road_name", "processed_hour").agg(
        weighted_speed().alias("weighted_avg_speed"), F.avg("counted_cars").alias("avg_counted_cars")
    )
    return hourly.orderBy(F.col("road_name").asc_nulls_last(), "processed_hour")


def volatility(rows: DataFrame) -> DataFrame:
    """Weighted speed and its sample deviation per road (null for a single reading)."""
    return rows.groupBy("road_name").agg(
        weighted_speed().alias("weighted_avg_speed"), F.stddev_samp("average_speed").alias("std_average_speed")
    )


def most_volatile(roads: DataFrame, n: int = 20) -> DataFrame:
    return roads.orderBy(F.col("std_average_speed").desc_nulls_last(), "road_name").limit(n)


def least_volatile(roads: DataFrame, n: int = 20) -> DataFrame:
    """The tail of the same ranking, in ranking order; roads without a deviation rank last."""
    tail = roads.orderBy(F.col("std_average_speed").asc_nulls_first(), F.col("road_name").desc()).limit(n)
    return tail.orderBy(F.col("std_average_speed").desc_nulls_last(), "road_name")


def by_road(roads: DataFrame) -> DataFrame:
    return roads.orderBy(F.col("road_name").asc_nulls_last())


def longest_first(roads: DataFrame) -> DataFrame:
    return roads.orderBy(F.col("std_average_speed").desc_nulls_last(), "road_name")


# --- selections ----------------------------------------------------------------------


def road_choices(rows: DataFrame) -> DataFrame:
    """Names for a selection list, sorted."""
    return rows.select("road_name").distinct().orderBy(F.col("road_name").asc_nulls_last())


def for_roads(rows: DataFrame, roads: Iterable[str] = ()) -> DataFrame:
    """Rows of the chosen roads; all rows when none is chosen."""
    chosen = list(roads)
    return rows.where(F.col("road_name").isin(chosen)) if chosen else rows


def for_road(rows: DataFrame, road: str) -> DataFrame:
    return rows.where(F.col("road_name") == road)


# --- chart data ----------------------------------------------------------------------


def heatmap_cells(slots: DataFrame) -> DataFrame:
    """Unweighted mean per weekday and hour, over whatever roads ``slots`` holds.

    Ordered as drawn: Monday first, latest hour on top.
    """
    cells = slots.groupBy("processed_day", "processed_hour").agg(F.avg("weighted_avg_speed").alias("mean_speed"))
    return cells.orderBy(day_rank(F.col("processed_day")), F.col("processed_hour").desc())


def heatmap_matrix(slots: DataFrame) -> DataFrame:
    """Hours as rows, weekdays as columns in calendar order."""
    return slots.groupBy("processed_hour").pivot("processed_day", list(DAYS)).agg(F.avg("weighted_avg_speed"))


def series(rows: DataFrame, axis: list[str], measures: dict[str, str]) -> DataFrame:
    """Long form of a two-line chart: one row per point and measure."""
    return rows.unpivot(axis, [F.col(name).cast("double").alias(name) for name in measures], "measure", "y").replace(
        measures, subset=["measure"]
    )


def health_series(health: DataFrame) -> DataFrame:
    """Dead and missing percentages by month, stacked-bar form."""
    dated = health.withColumn("date", month_start(F.col("processed_year"), F.col("processed_month")))
    long = dated.unpivot(["date"], ["dead_percent", "missing_reading_percent"], "Error Type", "Percent")
    label = F.when(F.col("Error Type") == "dead_percent", "Dead Readings").otherwise("Missing Readings")
    return long.withColumn("Label", label)


def scoreboard(weekly: DataFrame, figures: DataFrame) -> DataFrame:
    """The start page's single row.

    ``weekly`` holds the weighted speed per weekday and hour, ``figures`` the period
    comparison with ``latest_timestamp``. Of tied extreme slots the first in the week is named.
    """
    slot = F.concat_ws(" ", "processed_day", "processed_hour")
    rank = F.struct(day_rank(F.col("processed_day")), F.col("processed_hour"))
    first = lambda which: F.min_by(slot, F.when(F.col("slot") == which, rank))
    slots = (
        labelled_slots(weekly)
        .agg(first("busiest").alias("b"), first("lightest").alias("l"))
        # When one slot is both extremes it is named twice.
        .select(F.struct(F.col("b").alias("busiest"), F.coalesce("l", "b").alias("lightest")))
        .scalar()
    )
    return figures.select(
        "*", slots.getField("busiest").alias("busiest_slot"), slots.getField("lightest").alias("lightest_slot")
    )
