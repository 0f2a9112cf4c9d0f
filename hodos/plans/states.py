"""Partial results per day of reading, from which tests and reports are put together.

A day's rows only change when a run touches the day. So a run works out the states of the days it
touched, replaces them, and leaves all others as they are: data tests, headline figures, daily
totals, busiest slots and health never look at the hourly rows of settled days again. Whatever is
kept can be merged: counts, sums, maxima, one row per device and day for exact distinct counts,
and a HyperLogLog sketch of the day's devices for estimates over any span of days. Roads are not
part of a state: the dimension may rename a device's road at any time, reports join it as it is.

Both keys contain the time of the reading, so a key that occurs twice does so within one day, and
uniqueness can be tested day by day.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from hodos.functions.measures import speed_volume
from hodos.operators import quality
from hodos.plans import marts, reporting
from hodos.session import cut
from hodos.sources.tables import DIM_ROADS, FCT_MEASUREMENTS, STG_TRAFFIC, Table, Warehouse



def _table(name: str, columns: str) -> Table:
    return Table(f"state_{name}", f"{columns}, day string", ("day",))


STAGED_COLUMNS = ("traffic_id", "device_id", "processed_at", "counted_cars", "average_speed")
FACT_COLUMNS = ("device_id", "processed_at", "is_ghost_reading", "is_dead", "is_impossible_speed", "is_quality")
_nulls = lambda columns: "".join(f", null_{c} bigint" for c in columns)
STAGED_DAYS = _table("staged_days", f"n_rows bigint, newest_ingested_at timestamp_ntz, n_repeated bigint{_nulls(STAGED_COLUMNS)}")
FACT_DAYS = _table(
    "fact_days", f"n_rows bigint, newest_slot timestamp_ntz, newest_reading timestamp_ntz, devices binary, n_orphans bigint, n_repeated bigint{_nulls(FACT_COLUMNS)}"
)
DEVICE_DAYS = _table(
    "device_days",
    "device_id string, n_rows bigint, n_quality bigint, cars bigint, speed_cars double, latest timestamp_ntz, n_dead bigint, n_ghost bigint, n_impossible bigint, n_missing bigint",
)
HOUR_DAYS = _table("hour_days", "processed_day string, processed_hour string, cars bigint, speed_cars double")
STATES = (STAGED_DAYS, FACT_DAYS, DEVICE_DAYS, HOUR_DAYS)


def _by_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.col("processed_at").cast("date").cast("string"))


def _tested(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], first: list[Column], then: list[Column]) -> DataFrame:
    """One row a day: how many keys occur more than once, how many values are null, and ``then``
    over what ``first`` is for each key. One exchange by key serves all of it."""
    keyed = _by_day(rows).groupBy("day", *keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns], *first)
    there = " AND ".join(["n > 1", *[f"{k} IS NOT NULL" for k in keys]])
    return keyed.groupBy("day").agg(F.sum("n").alias("n_rows"), F.count_if(F.expr(there)).alias("n_repeated"), *[F.sum(f"null_{c}").alias(f"null_{c}") for c in columns], *then)


def staged_days(rows: DataFrame) -> DataFrame:
    newest = F.max("ingested_at").alias("newest_ingested_at")
    return _tested(rows, ["traffic_id"], STAGED_COLUMNS, [newest], [F.max("newest_ingested_at").alias("newest_ingested_at")])


def device_parts(rows: DataFrame) -> DataFrame:
    """All that is kept of a device's day, in one pass over the hours: counts, sums and how often
    each hour occurs. A group for each hour would be as many as there are rows. Measures are those
    of quality readings."""
    good = lambda column: F.when(F.col("is_quality"), column)
    flags = {"n_dead": "is_dead", "n_ghost": "is_ghost_reading", "n_impossible": "is_impossible_speed", "n_missing": "is_missing"}
    at = F.col("processed_at")
    return _by_day(rows).groupBy("day", "device_id", quality.past_hour(at).alias("past")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("is_quality")).alias("n_quality"),
        F.sum(good(F.col("counted_cars"))).alias("cars"),
        F.sum(good(speed_volume())).alias("speed_cars"),
        F.max(good(at)).alias("latest"),
        *[F.count_if(F.col(flag)).alias(name) for name, flag in flags.items()],
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in FACT_COLUMNS],
        F.max(F.when(~F.col("is_missing"), at)).alias("newest_reading"),
        F.max(at).alias("newest_slot"),
        *quality.hour_counts(at),
    )


def fact_days(parts: DataFrame, devices: DataFrame) -> DataFrame:
    """Tests of the fact, its newest hour and reading, and a sketch of the devices with a reading
    of quality. An orphan is a row whose device the dimension does not know."""
    known = devices.where("device_id IS NOT NULL").select("device_id").distinct().withColumn("is_known", F.lit(True))
    marked = parts.join(known, "device_id", "left")
    orphan = F.col("device_id").isNotNull() & F.col("is_known").isNull()
    keyed = F.col("device_id").isNotNull() & F.col("day").isNotNull()
    return marked.groupBy("day").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum(F.when(keyed, quality.repeated_hours()).otherwise(0)).alias("n_repeated"),
        *[F.sum(f"null_{c}").alias(f"null_{c}") for c in FACT_COLUMNS],
        F.sum(F.when(orphan, F.col("n_rows")).otherwise(0)).alias("n_orphans"),
        F.hll_sketch_agg(F.when(F.col("n_quality") > 0, F.col("device_id")), 14).alias("devices"),
        F.max("newest_reading").alias("newest_reading"),
        F.max("newest_slot").alias("newest_slot"),
    )


def device_days(parts: DataFrame) -> DataFrame:
    """Counts and sums of a device's day."""
    counts = ("n_rows", "n_quality", "cars", "speed_cars")
    flags = ("n_dead", "n_ghost", "n_impossible", "n_missing")
    return parts.groupBy("day", "device_id").agg(*[F.sum(c).alias(c) for c in counts], F.max("latest").alias("latest"), *[F.sum(c).alias(c) for c in flags])


def hour_days(rows: DataFrame) -> DataFrame:
    """Cars and speed of every hour of a day, over quality readings."""
    return _by_day(rows.where("is_quality")).groupBy("day", "processed_day", "processed_hour").agg(
        F.sum("counted_cars").alias("cars"), F.sum(speed_volume()).alias("speed_cars")
    )


# --- keeping them ------------------------------------------------------------------------


def mark(warehouse: Warehouse) -> datetime:
    """Newest ingestion that staging holds, from its days; of a table without states, from its rows."""
    if not warehouse.exists(STAGED_DAYS):
        return warehouse.latest(STG_TRAFFIC, "ingested_at")
    return warehouse.latest(STAGED_DAYS, "newest_ingested_at")


def newest_hour(warehouse: Warehouse, reading: bool) -> datetime:
    """The newest hour of the fact, or the newest with a reading."""
    empty, column = datetime(1970, 1, 1), "newest_reading" if reading else "newest_slot"
    if warehouse.exists(FACT_DAYS):
        return warehouse.latest(FACT_DAYS, column)
    rows = warehouse.read(FCT_MEASUREMENTS)
    return (rows.where("NOT is_missing") if reading else rows).agg(F.max("processed_at")).first()[0] or empty


def refresh_staged(warehouse: Warehouse, days: Sequence[str | None] | None) -> None:
    """States of the days of staging (None: all)."""
    if days is not None and not days:
        return
    days = days if warehouse.exists(STAGED_DAYS) else None
    warehouse.replace_partitions(STAGED_DAYS, staged_days(warehouse.read(STG_TRAFFIC, days=days)), whole=days is None)


def refresh_measured(warehouse: Warehouse, first: date | None) -> None:
    """States of the days of the fact from ``first`` on (None: all). The newest hour, from which
    the next run looks back, is the last thing written."""
    missing = not all(warehouse.exists(t) for t in (FACT_DAYS, DEVICE_DAYS, HOUR_DAYS))
    since = None if first is None or missing else datetime(first.year, first.month, first.day)
    rows = warehouse.read(FCT_MEASUREMENTS, since=since)
    parts = cut(device_parts(rows))
    made = {DEVICE_DAYS: device_days(parts), HOUR_DAYS: hour_days(rows), FACT_DAYS: fact_days(parts, warehouse.read(DIM_ROADS))}
    for table, state in made.items():
        warehouse.replace_partitions(table, state, whole=since is None)


# --- what is put together from them -----------------------------------------------------


def _report(days: DataFrame, table: str, columns: Sequence[str], named: dict[str, tuple[str, str]]) -> DataFrame:
    """Test results over all days, in the form of :mod:`hodos.operators.quality`."""
    named = {f"null_{c}": (c, "not_null") for c in columns} | named
    sums = days.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in named])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("test_name"), F.col(n).cast("bigint").alias("failing_rows")) for n, (c, t) in named.items()])
    rows = sums.select(F.lit(table).alias("table_name"), F.inline(each))
    return rows.withColumn("status", F.when(F.col("failing_rows") == 0, "pass").otherwise("fail"))


def staged_report(warehouse: Warehouse) -> DataFrame:
    return _report(warehouse.read(STAGED_DAYS), "stg_traffic", STAGED_COLUMNS, {"n_repeated": ("traffic_id", "unique")})


def fact_report(warehouse: Warehouse) -> DataFrame:
    named = {"n_repeated": ("device_id,processed_at", "unique"), "n_orphans": ("device_id", "relationships")}
    return _report(warehouse.read(FACT_DAYS), "fct_measurements", FACT_COLUMNS, named)


def _dated(warehouse: Warehouse, table: Table) -> DataFrame:
    return warehouse.read(table).withColumn("processed_date", F.col("day").cast("date")).drop("day")


def _periods(warehouse: Warehouse, days: int) -> tuple[date | None, DataFrame]:
    """Newest day with a reading of quality, and the device days of both periods."""
    rows = _dated(warehouse, DEVICE_DAYS).where("n_quality > 0")
    newest = rows.agg(F.max("processed_date")).first()[0]
    start, end = F.date_sub(F.lit(newest), 2 * days), F.date_sub(F.lit(newest), days)
    period = F.when(F.col("processed_date") >= end, "last").otherwise("previous")
    return newest, rows.where(F.col("processed_date") >= start).withColumn("period", period)


def figures(warehouse: Warehouse, days: int = 30) -> DataFrame:
    """The headline figures of both periods, one row each, as of :func:`reporting.period_figures`."""
    _, rows = _periods(warehouse, days)
    named = rows.join(warehouse.read(DIM_ROADS).select("device_id", "road_name"), "device_id", "left")
    return named.groupBy("period").agg(
        (F.sum("speed_cars") / F.nullif(F.sum("cars"), F.lit(0))).alias("weighted_avg_speed"),
        F.sum("cars").alias("sum_counted_cars"),
        F.countDistinct("road_name").alias("distinct_roads_count"),
        F.countDistinct("device_id").alias("distinct_devices_count"),
        F.max("latest").alias("latest_timestamp"),
    )


def kpi(warehouse: Warehouse, days: int = 30, period: str = "last", with_time: bool = True) -> DataFrame:
    """:func:`reporting.kpi` of a period; one row, also when there is nothing to count."""
    columns = [*reporting.KPI_COLUMNS, *(["latest_timestamp"] if with_time else [])]
    of = lambda c: F.coalesce(F.max(c), F.lit(0)) if c.startswith("distinct") else F.max(c)
    return figures(warehouse, days).where(F.col("period") == period).agg(*[of(c).alias(c) for c in columns])


def daily_speed_count(warehouse: Warehouse, days: int = 30) -> DataFrame:
    _, rows = _periods(warehouse, days)
    return rows.where("period = 'last'").groupBy("processed_date").agg(
        F.sum("cars").alias("total_counted_cars"), (F.sum("speed_cars") / F.nullif(F.sum("cars"), F.lit(0))).alias("weighted_avg_speed")
    )


def busiest_times(warehouse: Warehouse, days: int = 30) -> DataFrame:
    rows = _dated(warehouse, HOUR_DAYS)
    newest = rows.agg(F.max("processed_date")).first()[0]
    window = rows.where(F.col("processed_date") >= F.date_sub(F.lit(newest), days))
    slots = window.groupBy("processed_day", "processed_hour").agg((F.sum("speed_cars") / F.nullif(F.sum("cars"), F.lit(0))).alias("weighted_avg_speed"))
    return reporting.extreme_slots(slots).select("processed_day", "processed_hour", "weighted_avg_speed")


def device_health(warehouse: Warehouse) -> DataFrame:
    """:func:`marts.device_health` from the device days."""
    months = _dated(warehouse, DEVICE_DAYS).groupBy(F.year("processed_date").alias("processed_year"), F.month("processed_date").alias("processed_month"))
    counts = months.agg(
        F.sum("n_rows").cast("bigint").alias("readings"),
        *[F.sum(f"n_{c}").cast("bigint").alias(f"{name}_count") for c, name in (("dead", "dead"), ("ghost", "ghost"), ("impossible", "impossible_speed"), ("missing", "missing_reading"))],
    )
    return marts.with_shares(counts)


def estimated_devices(warehouse: Warehouse, first: date, last: date) -> DataFrame:
    """About how many devices had a reading of quality in a span of days, from one sketch a day."""
    span = _dated(warehouse, FACT_DAYS).where(F.col("processed_date").between(F.lit(first), F.lit(last)))
    return span.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("devices")), F.lit(0)).alias("devices"))


def touched_days(batch: DataFrame) -> list[str | None]:
    """The days a batch has readings of, one row a day; None for readings without a time."""
    found = cut(batch.select(F.col("processed_at").cast("date").cast("string").alias("day")).distinct()).collect()
    return sorted((r.day for r in found), key=str)
