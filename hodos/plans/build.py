"""One run of the warehouse: silver, facts, gold and reports, then the data tests."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from hodos.functions.calendar import SPINE_START, hour_spine
from hodos.operators import quality
from hodos.plans import facts, marts, reporting, roads, staging, states
from hodos.session import cut
from hodos.sources.tables import DIM_ROADS, FCT_MEASUREMENTS, MRT_TRAFFIC_ROAD, STG_TRAFFIC, Table, Warehouse

MRT_LAST_DAYS = Table("mrt_last_30_days_traffic_road")
MRT_DEVICE_HEALTH = Table("mrt_device_health")
LAST_KPI = Table("fct_last_30_days_KPI")
PREVIOUS_KPI = Table("fct_previous_30_days_KPI")
DAILY_SPEED_COUNT = Table("fct_last_30_days_daily_speed_count")
BUSIEST_TIMES = Table("fct_last_30_days_busiest_times")


@dataclass
class Run:
    """What an incremental run did besides writing tables."""

    bound: datetime | None = None  # settled up to and including this hour
    late: DataFrame | None = None  # readings that came too late for the fact


def refresh_silver(warehouse: Warehouse, raw: DataFrame, full: bool) -> DataFrame | None:
    """Staging and dimension; returns the staged batch of an incremental run."""
    warehouse.recover(STG_TRAFFIC, DIM_ROADS, *states.STATES)
    if full or not warehouse.exists(STG_TRAFFIC):
        warehouse.replace(STG_TRAFFIC, staging.stage(raw))
        warehouse.replace(DIM_ROADS, roads.latest_roads(warehouse.read(STG_TRAFFIC)))
        states.refresh_staged(warehouse, None)
        return None
    fresh = staging.after(raw, states.mark(warehouse))
    batch = cut(staging.stage(fresh))
    days = states.touched_days(batch)
    warehouse.upsert(STG_TRAFFIC, batch, staging.KEY, staging.staging_order())
    # what is newer than the dimension came with this batch, so lies in its days
    changed = staging.after(warehouse.read(STG_TRAFFIC, days=days), warehouse.latest(DIM_ROADS, "ingested_at"))
    warehouse.upsert(DIM_ROADS, cut(roads.latest_roads(changed)), roads.KEY, roads.road_order())
    states.refresh_staged(warehouse, days)
    return batch


def refresh_facts(warehouse: Warehouse, as_of: datetime, full: bool, lookback_days: int, anchor: str, spine_start: datetime) -> datetime | None:
    """The dense fact; returns the bound an incremental run reprocessed from."""
    warehouse.recover(STG_TRAFFIC, DIM_ROADS, FCT_MEASUREMENTS)
    staged, devices = warehouse.read(STG_TRAFFIC), warehouse.read(DIM_ROADS)
    last = as_of.replace(minute=0, second=0, microsecond=0)
    if full or not warehouse.exists(FCT_MEASUREMENTS):
        warehouse.replace(FCT_MEASUREMENTS, facts.measurements_by_day(staged, devices, spine_start, last), sort_by=("device_id", "processed_at"))
        states.refresh_measured(warehouse, None)
        return None
    # "spine" looks back from the newest hour generated so far, whether or not it had
    # data; "data" from the newest hour with a reading, so an outage loses nothing.
    bound = facts.reprocess_bound(states.newest_hour(warehouse, reading=anchor == "data"), lookback_days)
    rebuilt = facts.recent_measurements(warehouse.read(STG_TRAFFIC, since=bound), devices, bound, spine_start, last, by_day=True)
    first = facts.reprocessed_from(bound, spine_start)
    if first <= last:
        # Every device of the dimension has every hour of the range in ``rebuilt``; devices never leave it.
        warehouse.rewrite(FCT_MEASUREMENTS, rebuilt, first, last)
    states.refresh_measured(warehouse, bound.date())
    return bound


def refresh_gold(warehouse: Warehouse, days: int = 30) -> None:
    """Gold and reports. The wide table is built anew, as a road's new name reaches all of its
    rows; reports and health are put together from the states of days."""
    warehouse.recover(DIM_ROADS, FCT_MEASUREMENTS, *states.STATES)
    facts_table = warehouse.read(FCT_MEASUREMENTS)
    warehouse.replace(MRT_TRAFFIC_ROAD, marts.laid_out(marts.traffic_road(facts_table, warehouse.read(DIM_ROADS))), sort_by=("processed_at", "road_name"))
    warehouse.replace(MRT_DEVICE_HEALTH, marts.by_month(states.device_health(warehouse)))
    warehouse.replace(MRT_LAST_DAYS, marts.laid_out(marts.last_days(warehouse.read(MRT_TRAFFIC_ROAD), days)))
    warehouse.replace(LAST_KPI, states.kpi(warehouse, days))
    warehouse.replace(PREVIOUS_KPI, states.kpi(warehouse, days, "previous", with_time=False))
    warehouse.replace(DAILY_SPEED_COUNT, states.daily_speed_count(warehouse, days).orderBy("processed_date"))
    warehouse.replace(BUSIEST_TIMES, states.busiest_times(warehouse, days))


def run(
    warehouse: Warehouse,
    raw: DataFrame,
    as_of: datetime,
    full: bool = False,
    lookback_days: int = 2,
    anchor: str = "spine",
    spine_start: datetime = SPINE_START,
    gold: bool = True,
    gate: bool = True,
) -> Run:
    """Bring every table up to ``as_of``; the first run of a table is always full.

    Repeating a run changes nothing: nothing is newer than the high-water mark, and the
    reprocessed hours come out the same. Unless ``gate`` is off, a failed data test stops the run
    (:class:`hodos.operators.quality.DataTestError`) before anything that depends on the
    tested tables is built.
    """

    def stop_if_failed(tests: list[DataFrame]) -> None:
        if gate:
            quality.require(quality.report(tests))

    batch = refresh_silver(warehouse, raw, full)
    stop_if_failed([states.staged_report(warehouse), *dimension_tests(warehouse.read(DIM_ROADS))])
    bound = refresh_facts(warehouse, as_of, full, lookback_days, anchor, spine_start)
    slots = hour_spine(warehouse.spark, spine_start, as_of)
    stop_if_failed([*slot_tests(slots), states.fact_report(warehouse)])
    if gold:
        refresh_gold(warehouse)
        tables = (MRT_TRAFFIC_ROAD, DAILY_SPEED_COUNT, LAST_KPI)
        stop_if_failed(gold_tests(*[warehouse.read(t) for t in tables]))
    late = None if batch is None or bound is None else facts.late_readings(batch, bound)
    return Run(bound, late)


def kept_tests(warehouse: Warehouse, spine_start: datetime, as_of: datetime) -> DataFrame:
    """The declared tests of silver, put together from what runs kept of every day."""
    slots = hour_spine(warehouse.spark, spine_start, as_of)
    return quality.report([states.staged_report(warehouse), states.fact_report(warehouse), *dimension_tests(warehouse.read(DIM_ROADS)), *slot_tests(slots)])


def homepage_tables(warehouse: Warehouse) -> dict[str, DataFrame]:
    """The four report tables the start page shows."""
    return {
        "busiest_times": warehouse.read(BUSIEST_TIMES),
        "daily_speed_count": warehouse.read(DAILY_SPEED_COUNT),
        "last_kpi": warehouse.read(LAST_KPI),
        "previous_kpi": warehouse.read(PREVIOUS_KPI),
    }


def silver_tests(staged: DataFrame, devices: DataFrame) -> list[DataFrame]:
    return [
        quality.unique(staged, "stg_traffic", "traffic_id"),
        quality.not_null(staged, "stg_traffic", ["traffic_id", "device_id", "processed_at", "counted_cars", "average_speed"]),
        *dimension_tests(devices),
    ]


def dimension_tests(devices: DataFrame) -> list[DataFrame]:
    return [quality.unique(devices, "dim_roads", "device_id"), quality.not_null(devices, "dim_roads", ["device_id", "road_name"])]


def slot_tests(slots: DataFrame) -> list[DataFrame]:
    return [quality.unique(slots, "util_hours", "hourly_slot"), quality.not_null(slots, "util_hours", ["hourly_slot"])]


def fact_tests(slots: DataFrame, measured: DataFrame, devices: DataFrame) -> list[DataFrame]:
    flags = ["is_ghost_reading", "is_dead", "is_impossible_speed", "is_quality"]
    return [
        *slot_tests(slots),
        quality.unique_hourly(measured, "fct_measurements", "device_id", "processed_at"),
        quality.not_null(measured, "fct_measurements", ["device_id", "processed_at", *flags]),
        quality.relationship(measured, devices, "device_id", "fct_measurements"),
    ]


def gold_tests(mart: DataFrame, daily: DataFrame, figures: DataFrame) -> list[DataFrame]:
    return [
        quality.not_null(mart, "mrt_traffic_road", ["device_id"]),
        quality.unique(daily, "fct_last_30_days_daily_speed_count", "processed_date"),
        quality.not_null(daily, "fct_last_30_days_daily_speed_count", ["processed_date", "total_counted_cars", "weighted_avg_speed"]),
        quality.not_null(figures, "fct_last_30_days_KPI", ["weighted_avg_speed"]),
    ]


def data_tests(
    spark: SparkSession,
    staged: DataFrame,
    devices: DataFrame,
    measured: DataFrame,
    mart: DataFrame,
    daily: DataFrame,
    figures: DataFrame,
    spine_start: datetime,
    as_of: datetime,
) -> DataFrame:
    """The declared tests of every table, one result row each."""
    slots = hour_spine(spark, spine_start, as_of)
    return quality.report(silver_tests(staged, devices) + fact_tests(slots, measured, devices) + gold_tests(mart, daily, figures))


def freshness(raw: DataFrame, as_of: datetime, warn_hours: int = 24, error_hours: int = 36) -> DataFrame:
    """Age of the newest ingestion and what it means."""
    now = F.lit(as_of).cast("timestamp_ntz")
    newest = raw.agg(F.max("ingested_at").alias("newest_ingested_at"))
    limit = lambda n: F.col("newest_ingested_at") + F.expr(f"INTERVAL {n} HOUR")
    status = (
        F.when(F.col("newest_ingested_at").isNull() | (now > limit(error_hours)), "error")
        .when(now > limit(warn_hours), "warn")
        .otherwise("pass")
    )
    age = F.timestamp_diff("SECOND", F.col("newest_ingested_at"), now)
    return newest.select("newest_ingested_at", age.alias("age_seconds"), status.alias("status"))
