"""Every query by name, over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from hodos.functions.calendar import full_day, greek_holidays, hour_spine, hours, next_local_hour, reporting_day
from hodos.functions.measures import published, rounded
from hodos.operators import bins, boosting, drift, encode, quality
from hodos.plans import build, dashboard, facts, features, marts, monitoring, reporting, roads, runs, scoring, staging, states, training
from hodos.session import cut, prepare, scratch
from hodos.sources import bucketed, lake, testdata
from hodos.sources.tables import DIM_ROADS, FCT_MEASUREMENTS, MRT_TRAFFIC_ROAD, STG_TRAFFIC, Warehouse
from hodos.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(function(prepare(spark), sf_dir))

    QUERIES[function.__name__] = run
    return function


# --- inputs --------------------------------------------------------------------------
# Silver queries start at the raw records. Reports read gold tables, as they would in
# production: the first one in a session builds the warehouse in the shared folder.

_built: dict[tuple[str, str, str], object] = {}


def _once(kind: str, spark: SparkSession, sf_dir: str, make: Callable[[], object]):
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def build_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    first, last = testdata.hour_range(spark, sf_dir)
    warehouse = Warehouse(spark, scratch(spark, "warehouse"))
    build.run(warehouse, testdata.raw_traffic(spark, sf_dir), as_of=last, full=True, spine_start=first)
    return warehouse


def warehouse_of(spark: SparkSession, sf_dir: str) -> Warehouse:
    return _once("full", spark, sf_dir, lambda: build_warehouse(spark, sf_dir))


def first_run_clock(first: datetime) -> datetime:
    """When the first of the two incremental runs takes place."""
    return datetime(first.year, first.month, first.day) + timedelta(days=20, hours=5)


def incremental_of(spark: SparkSession, sf_dir: str) -> Warehouse:
    """A warehouse after two runs: one up to a past moment, one for the rest."""

    def make() -> Warehouse:
        first, last = testdata.hour_range(spark, sf_dir)
        raw, clock1 = testdata.redelivered(spark, sf_dir), first_run_clock(first)
        warehouse = Warehouse(spark, scratch(spark, "incremental"))
        early = raw.where(F.col("ingested_at") <= F.lit(clock1).cast("timestamp_ntz"))
        build.run(warehouse, early, as_of=clock1, spine_start=first, gold=False)
        warehouse.after_first = warehouse.latest(STG_TRAFFIC, "ingested_at")
        warehouse.second = build.run(warehouse, raw, as_of=last, spine_start=first, gold=False)
        return warehouse

    return _once("incremental", spark, sf_dir, make)


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stage(testdata.raw_traffic(spark, sf_dir))


def silver_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging for queries that read it twice; deduplicating is the expensive part."""
    return cut(silver(spark, sf_dir))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse_of(spark, sf_dir).read(MRT_TRAFFIC_ROAD).select(*marts.MART_COLUMNS)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.long_history(spark, sf_dir)


def today(spark: SparkSession, sf_dir: str) -> date:
    """The clock of the long history: its newest date. Looked up once per session, a job
    would be told the date."""
    return _once("today", spark, sf_dir, lambda: history(spark, sf_dir).agg(F.max("processed_date")).first()[0])


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.base_features(features.training_rows(history(spark, sf_dir), today(spark, sf_dir)))


def closed_form(rows: DataFrame) -> DataFrame:
    """A stand-in for the fitted model with the same interface and a formula to check."""
    kept = F.struct(*[F.col(name) for name in rows.columns]).alias("_row")
    timed = features.time_features(rows.select("*", kept))
    speed = (
        F.lit(30.0)
        + F.lit(20.0) * F.col("hour_cos")
        - F.lit(5.0) * F.col("is_rush_hour")
        + F.lit(3.0) * F.col("is_weekend")
        + F.lit(2.0) * F.col("is_holiday")
        + F.col("device_id").cast("bigint") % 10
    )
    return timed.select("_row.*", published(speed).alias("prediction"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-set predictions, kept: charts pass over them for the range, then for counts."""
    return cut(closed_form(base(spark, sf_dir)))


def stored_reference(spark: SparkSession, sf_dir: str, settings: training.ModelSettings) -> DataFrame:
    """What a training run stores for monitoring, once per session and kind, read back."""

    def make() -> str:
        train = features.split_marked(base(spark, sf_dir)).where("NOT is_test").drop("is_test")
        folder = scratch(spark, "model")
        training.write_reference(train, folder, settings)
        return f"{folder}/reference"

    return spark.read.parquet(_once(f"reference-{settings.sample_size}", spark, sf_dir, make))


def reference_and_current(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The whole training part and the last two weeks; drift needs counts by value, no sample."""
    reference = stored_reference(spark, sf_dir, training.ModelSettings(sample_size=None))
    return reference, monitoring.current_rows(history(spark, sf_dir), today(spark, sf_dir))


def land(spark: SparkSession, sf_dir: str) -> str:
    """The raw records as landed feed files, one folder per day of reading."""
    folder = scratch(spark, "landing")
    raw = testdata.raw_traffic(spark, sf_dir).drop("ingested_at", "year", "month")
    dated = raw.withColumn("date", F.col("appprocesstime").cast("date"))
    dated.hint("rebalance", "date").write.partitionBy("date").json(folder)
    return folder


def a_day(spark: SparkSession, sf_dir: str) -> date:
    """The day with most readings."""
    at = testdata.table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).count()
    return at.agg(F.max_by("day", F.struct("count", "day"))).first()[0]


def next_morning():
    return full_day(F.col("date").cast("timestamp_ntz")) + hours(29)


def fresh_lake(spark: SparkSession, sf_dir: str) -> str:
    root = scratch(spark, "lake")
    lake.write_batches(lake.stamp(lake.read_landing(spark, land(spark, sf_dir)), next_morning()), root)
    return root


# --- silver --------------------------------------------------------------------------


@query
def stg_traffic(spark, sf_dir):
    return silver(spark, sf_dir)


@query
def dim_roads(spark, sf_dir):
    return roads.latest_roads(silver(spark, sf_dir)).drop("described_at")


@query
def util_hours(spark, sf_dir):
    return hour_spine(spark, *testdata.hour_range(spark, sf_dir))


@query
def fct_measurements(spark, sf_dir):
    staged = silver_once(spark, sf_dir)
    return facts.measurements(staged, roads.latest_roads(staged), *testdata.hour_range(spark, sf_dir))


def month_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold table straight from the raw records, without the dense grid."""
    staged = silver_once(spark, sf_dir)
    observed = facts.observed_measurements(staged, *testdata.hour_range(spark, sf_dir))
    return marts.traffic_road(observed, roads.latest_roads(staged))


@query
def mrt_traffic_road(spark, sf_dir):
    return month_mart(spark, sf_dir)


def by_device(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Staging and the roads as tables bucketed by device, written once per session."""

    def make() -> tuple[DataFrame, DataFrame]:
        folder = scratch(spark, "bucketed")
        staged = bucketed.write(silver(spark, sf_dir), f"{folder}/staged", "device_id")
        return staged, bucketed.write(roads.latest_roads(staged), f"{folder}/roads", "device_id")

    return _once("bucketed", spark, sf_dir, make)


@query
def fct_by_device(spark, sf_dir):
    """The dense fact from bucketed tables."""
    return facts.measurements_in_place(*by_device(spark, sf_dir), *testdata.hour_range(spark, sf_dir))


@query
def mrt_by_device(spark, sf_dir):
    """Gold from bucketed tables, gap fill and join with the roads without an exchange."""
    dense = facts.measurements_in_place(*by_device(spark, sf_dir), *testdata.hour_range(spark, sf_dir))
    return marts.traffic_road(dense, by_device(spark, sf_dir)[1])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cars and weighted speed per day, from raw records to report in one go."""
    return rounded(reporting.daily_speed_count(marts.last_days(month_mart(prepare(spark), sf_dir))))


@query
def warehouse_build(spark, sf_dir):
    """Full rebuild of every table from the raw records; rows per table."""
    warehouse = build_warehouse(spark, sf_dir)
    tables = (STG_TRAFFIC, DIM_ROADS, FCT_MEASUREMENTS, MRT_TRAFFIC_ROAD)
    counts = [
        warehouse.read(t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t.name).alias("table_name"), "n_rows") for t in tables
    ]
    return quality.report(counts)


# --- gold and reports ----------------------------------------------------------------


@query
def mart_layout(spark, sf_dir):
    return gold(spark, sf_dir)


@query
def dev_slice(spark, sf_dir):
    """One year of a partitioned table in the development target."""
    warehouse = Warehouse(spark, scratch(spark, "targets"), target="dev")
    warehouse.replace(MRT_TRAFFIC_ROAD, history(spark, sf_dir))
    return warehouse.read(MRT_TRAFFIC_ROAD).where("processed_year = 1998").select(*marts.MART_COLUMNS)


@query
def mrt_last_n_days(spark, sf_dir):
    return marts.last_days(history(spark, sf_dir))


@query
def device_health(spark, sf_dir):
    return marts.by_month(marts.device_health(warehouse_of(spark, sf_dir).read(FCT_MEASUREMENTS)))


@query
def device_health_spans(spark, sf_dir):
    """The same report from run-length facts, without generating an hour."""
    warehouse = warehouse_of(spark, sf_dir)
    bounds = testdata.hour_range(spark, sf_dir)
    spans = facts.measured_spans(warehouse.read(STG_TRAFFIC), warehouse.read(DIM_ROADS), *bounds)
    return marts.by_month(marts.device_health(spans, weight="hours"))


@query
def kpi_last(spark, sf_dir):
    return reporting.kpi(marts.last_days(history(spark, sf_dir)))


@query
def kpi_previous(spark, sf_dir):
    return reporting.kpi(marts.previous_days(history(spark, sf_dir)), with_time=False)


@query
def kpi_delta(spark, sf_dir):
    totals = reporting.period_totals(marts.both_periods(history(spark, sf_dir)))
    return reporting.delta_of(reporting.period_figures(totals))


@query
def distinct_counts(spark, sf_dir):
    mart = gold(spark, sf_dir)
    return reporting.kpi(mart).select("distinct_roads_count", "distinct_devices_count", "latest_timestamp")


@query
def daily_speed_count(spark, sf_dir):
    return reporting.daily_speed_count(marts.last_days(gold(spark, sf_dir)))


@query
def busiest_times(spark, sf_dir):
    return reporting.labelled_times(marts.last_days(gold(spark, sf_dir)))


@query
def homepage_tables(spark, sf_dir):
    """The stored report tables, one row each for table and number of rows."""
    tables = build.homepage_tables(warehouse_of(spark, sf_dir))
    return quality.report(
        [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, t in tables.items()]
    )


@query
def stored_kpi_last(spark, sf_dir):
    return build.homepage_tables(warehouse_of(spark, sf_dir))["last_kpi"]


@query
def stored_kpi_previous(spark, sf_dir):
    return build.homepage_tables(warehouse_of(spark, sf_dir))["previous_kpi"]


@query
def stored_daily(spark, sf_dir):
    return build.homepage_tables(warehouse_of(spark, sf_dir))["daily_speed_count"]


@query
def stored_busiest(spark, sf_dir):
    return build.homepage_tables(warehouse_of(spark, sf_dir))["busiest_times"]


@query
def stored_last_days(spark, sf_dir):
    return warehouse_of(spark, sf_dir).read(build.MRT_LAST_DAYS).select(*marts.MART_COLUMNS)


@query
def scoreboard(spark, sf_dir):
    totals = cut(reporting.period_totals(marts.both_periods(history(spark, sf_dir))))
    figures = reporting.delta_of(reporting.period_figures(totals), with_time=True)
    return dashboard.scoreboard(reporting.slots_of(totals), figures)


# --- dashboard -----------------------------------------------------------------------


@query
def heatmap_last_n(spark, sf_dir):
    """Over the stored window, as the start page reads it."""
    return dashboard.heatmap(warehouse_of(spark, sf_dir).read(build.MRT_LAST_DAYS))


@query
def spatiotemporal(spark, sf_dir):
    return dashboard.spatiotemporal(gold(spark, sf_dir))


@query
def speed_count(spark, sf_dir):
    return dashboard.speed_count(gold(spark, sf_dir))


@query
def volatility_last_n(spark, sf_dir):
    return dashboard.longest_first(dashboard.volatility(marts.last_days(history(spark, sf_dir))))


@query
def volatility_all(spark, sf_dir):
    return dashboard.by_road(dashboard.volatility(gold(spark, sf_dir)))


@query
def volatility_chart(spark, sf_dir):
    return dashboard.longest_first(dashboard.volatility(history(spark, sf_dir)))


@query
def top20_volatile(spark, sf_dir):
    return dashboard.most_volatile(dashboard.volatility(marts.last_days(history(spark, sf_dir))))


@query
def bottom20_volatile(spark, sf_dir):
    return dashboard.least_volatile(dashboard.volatility(marts.last_days(history(spark, sf_dir))))


@query
def heatmap_mean(spark, sf_dir):
    return dashboard.heatmap_cells(dashboard.spatiotemporal(gold(spark, sf_dir)))


@query
def heatmap_pivot(spark, sf_dir):
    return dashboard.heatmap_matrix(dashboard.spatiotemporal(gold(spark, sf_dir)))


@query
def road_choices(spark, sf_dir):
    return dashboard.road_choices(gold(spark, sf_dir))


@query
def road_filter_many(spark, sf_dir):
    return dashboard.for_roads(dashboard.speed_count(gold(spark, sf_dir)), ["ΜΕΣΟΓΕΙΩΝ", "ΚΗΦΙΣΙΑΣ"])


@query
def road_filter_one(spark, sf_dir):
    return dashboard.for_road(dashboard.spatiotemporal(gold(spark, sf_dir)), "ΚΗΦΙΣΙΑΣ")


@query
def twin_series(spark, sf_dir):
    daily = reporting.daily_speed_count(marts.last_days(gold(spark, sf_dir)))
    return dashboard.series(daily, ["processed_date"], {"weighted_avg_speed": "speed", "total_counted_cars": "volume"})


@query
def twin_series_roads(spark, sf_dir):
    lines = dashboard.speed_count(gold(spark, sf_dir))
    return dashboard.series(
        lines, ["road_name", "processed_hour"], {"weighted_avg_speed": "speed", "avg_counted_cars": "volume"}
    )


@query
def health_series(spark, sf_dir):
    return dashboard.health_series(marts.device_health(warehouse_of(spark, sf_dir).read(FCT_MEASUREMENTS)))


# --- clock ---------------------------------------------------------------------------


@query
def reporting_days(spark, sf_dir):
    events = testdata.table(spark, sf_dir, "events")
    return events.groupBy(reporting_day(F.col("ts")).alias("reporting_day")).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def next_hour_local(spark, sf_dir):
    moments = history(spark, sf_dir).select("processed_at").distinct()
    return moments.select("processed_at", next_local_hour(F.col("processed_at")).alias("local_hour"))


@query
def holidays(spark, sf_dir):
    years = history(spark, sf_dir).agg(F.min("processed_year").alias("a"), F.max("processed_year").alias("b")).first()
    return greek_holidays(spark, years.a, years.b)


# --- data tests ----------------------------------------------------------------------


@query
def dq_report(spark, sf_dir):
    warehouse = warehouse_of(spark, sf_dir)
    first, last = testdata.hour_range(spark, sf_dir)
    return build.data_tests(
        spark,
        warehouse.read(STG_TRAFFIC),
        warehouse.read(DIM_ROADS),
        warehouse.read(FCT_MEASUREMENTS),
        warehouse.read(MRT_TRAFFIC_ROAD),
        warehouse.read(build.DAILY_SPEED_COUNT),
        warehouse.read(build.LAST_KPI),
        first,
        last,
    )


@query
def dq_raw(spark, sf_dir):
    """The staging tests before deduplication and on rows that fail some of them."""
    typed = staging.typed(testdata.redelivered(spark, sf_dir))
    suspicious = typed.withColumn("average_speed", F.when(F.col("average_speed") <= 130, F.col("average_speed")))
    return quality.report(
        [
            quality.unique(typed, "raw_traffic", "traffic_id"),
            quality.unique(typed, "raw_traffic", "device_id", "processed_at"),
            quality.not_null(suspicious, "raw_traffic", ["traffic_id", "device_id", "processed_at", "counted_cars", "average_speed"]),
        ]
    )


@query
def dim_orphans(spark, sf_dir):
    """Readings of the month whose device the long history does not know."""
    known = history(spark, sf_dir).select("device_id").distinct()
    lost = quality.orphans(silver(spark, sf_dir), known, "device_id")
    return lost.select("traffic_id", "device_id", "processed_at")


@query
def source_freshness(spark, sf_dir):
    _, last = testdata.hour_range(spark, sf_dir)
    return build.freshness(testdata.raw_traffic(spark, sf_dir), last + timedelta(hours=36))


# --- lake ----------------------------------------------------------------------------


@query
def lake_write_read(spark, sf_dir):
    first, _ = testdata.hour_range(spark, sf_dir)
    return lake.read_lake(spark, fresh_lake(spark, sf_dir), year=first.year)


@query
def compact_months(spark, sf_dir):
    """Compacted months into which a day is landed a second time."""
    landing, root = land(spark, sf_dir), scratch(spark, "lake")
    lake.write_batches(lake.stamp(lake.read_landing(spark, landing), next_morning()), root)
    months = lake.read_lake(spark, root).select("year", "month").distinct().collect()  # partition values
    lake.compact_months(spark, root, sorted((row.year, row.month) for row in months))
    lake.ingest_day(spark, landing, root, a_day(spark, sf_dir), next_morning())
    return lake.read_lake(spark, root)


@query
def backfill_range(spark, sf_dir):
    first, _ = testdata.hour_range(spark, sf_dir)
    root = scratch(spark, "backfill")
    start = first.date() + timedelta(days=3)
    landing = land(spark, sf_dir)
    for _ in range(2):  # the second time changes nothing
        lake.backfill(spark, landing, root, start, start + timedelta(days=14), next_morning())
    lake.ingest_day(spark, landing, root, start + timedelta(days=1), next_morning())
    return lake.read_lake(spark, root)


@query
def missing_days(spark, sf_dir):
    """Days around and inside the history without an impossible reading."""
    first, last = testdata.hour_range(spark, sf_dir)
    raw = testdata.raw_traffic(spark, sf_dir)
    odd = raw.where((F.col("countedcars") == 0) & (F.col("average_speed") == 0))
    days = odd.select(F.col("appprocesstime").cast("date").alias("day"))
    return lake.missing_days(days, first.date() - timedelta(days=2), last.date() + timedelta(days=2))


# --- incremental ---------------------------------------------------------------------


@query
def inc_watermark_filter(spark, sf_dir):
    warehouse = incremental_of(spark, sf_dir)
    fresh = staging.after(testdata.redelivered(spark, sf_dir), warehouse.after_first)
    return fresh.select("deviceid", "appprocesstime", "countedcars", "average_speed", "ingested_at")


@query
def inc_upsert_stg(spark, sf_dir):
    return incremental_of(spark, sf_dir).read(STG_TRAFFIC)


@query
def inc_upsert_dim(spark, sf_dir):
    return incremental_of(spark, sf_dir).read(DIM_ROADS).drop("described_at")


@query
def inc_fct_lookback(spark, sf_dir):
    return incremental_of(spark, sf_dir).read(FCT_MEASUREMENTS)


@query
def inc_two_spellings(spark, sf_dir):
    """Staging after two runs, the second with corrections that spell the time differently."""
    first, _ = testdata.hour_range(spark, sf_dir)
    raw, warehouse = testdata.respelled(spark, sf_dir), Warehouse(spark, scratch(spark, "spellings"))
    early = raw.where(F.col("ingested_at") <= F.lit(first_run_clock(first)).cast("timestamp_ntz"))
    for rows in (early, raw):
        build.refresh_silver(warehouse, rows, full=False)
    return warehouse.read(STG_TRAFFIC)


@query
def inc_reports(spark, sf_dir):
    """Headline figures of both periods and their differences after two runs, from the states of days."""
    return reporting.delta_of(states.figures(incremental_of(spark, sf_dir)), with_time=True)


@query
def inc_daily(spark, sf_dir):
    return states.daily_speed_count(incremental_of(spark, sf_dir))


@query
def inc_busiest(spark, sf_dir):
    return states.busiest_times(incremental_of(spark, sf_dir))


@query
def inc_health(spark, sf_dir):
    return states.device_health(incremental_of(spark, sf_dir))


@query
def dq_incremental(spark, sf_dir):
    """Data tests after two runs, each of which looked at the days it touched."""
    return build.kept_tests(incremental_of(spark, sf_dir), *testdata.hour_range(spark, sf_dir))


@query
def late_rows(spark, sf_dir):
    return incremental_of(spark, sf_dir).second.late.select("device_id", "processed_at", "counted_cars", "average_speed")


@query
def run_report(spark, sf_dir):
    """What the steps of a run dropped, held back and merged, as they saw it themselves."""
    report, folder = runs.RunReport("run"), scratch(spark, "run")
    late = incremental_of(spark, sf_dir).second.late
    report.observe("facts", late, n_late=F.count(F.lit(1)), n_late_cars=F.sum("counted_cars")).write.parquet(f"{folder}/late")
    gaps = features.training_rows(history(spark, sf_dir), today(spark, sf_dir)).withColumn("road_name", F.nullif("road_name", F.lit("7")))
    features.base_features(gaps, report.observation("training")).write.parquet(f"{folder}/base")
    root = fresh_lake(spark, sf_dir)
    months = lake.read_lake(spark, root).select("year", "month").distinct().collect()  # partition values
    report.compactions(lake.compact_months(spark, root, sorted((m.year, m.month) for m in months)))
    return report.table(spark)


# --- streams -------------------------------------------------------------------------


@query
def stream_staging(spark, sf_dir):
    warehouse = Warehouse(spark, scratch(spark, "stream"))
    source = live.lake_stream(spark, fresh_lake(spark, sf_dir), files_per_batch=12)
    live.stream_staging(warehouse, source, scratch(spark, "offsets")).awaitTermination()
    return warehouse.read(STG_TRAFFIC)


def _drain(frame: DataFrame, folder: str) -> None:
    spark = frame.sparkSession
    (
        frame.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", scratch(spark, "offsets"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


@query
def stream_dedup(spark, sf_dir):
    """Keys the stateful deduplication lets through."""
    out = scratch(spark, "dedup")
    _drain(live.deduplicated(live.lake_stream(spark, fresh_lake(spark, sf_dir))).select("device_id", "processed_at"), out)
    return spark.read.parquet(out)


@query
def stream_daily(spark, sf_dir):
    """Daily totals of every day, drained twice; what lands in between corrects earlier days."""
    root, offsets = scratch(spark, "lake"), scratch(spark, "offsets")
    warehouse = Warehouse(spark, scratch(spark, "daily"))
    first, _ = testdata.hour_range(spark, sf_dir)
    raw = testdata.redelivered(spark, sf_dir).drop("year", "month").withColumn("date", F.col("ingested_at").cast("date"))
    early = F.col("ingested_at") <= F.lit(first_run_clock(first)).cast("timestamp_ntz")
    for part in (raw.where(early), raw.where(~early)):
        lake.write_batches(part, root)
        live.stream_daily(warehouse, live.lake_stream(spark, root), offsets).awaitTermination()
    return warehouse.read(live.DAILY_TOTALS)


def _drain_in_parts(spark: SparkSession, parts: list[Callable[[], None]], make: Callable[[], DataFrame]) -> DataFrame:
    """Runs the stream ``make`` builds to its end after each part has landed, from one checkpoint."""
    out, offsets = scratch(spark, "drained"), scratch(spark, "offsets")
    for land_part in parts:
        land_part()
        frame = make()
        (
            frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets)
            .outputMode("append").trigger(availableNow=True).start().awaitTermination()
        )
    return spark.read.schema(frame.schema).parquet(out)


def _lake_parts(spark: SparkSession, sf_dir: str, root: str) -> list[Callable[[], None]]:
    """The raw records in two parts: what was ingested up to the first run, and the rest."""
    first, _ = testdata.hour_range(spark, sf_dir)
    raw = testdata.raw_traffic(spark, sf_dir).drop("year", "month").withColumn("date", F.col("ingested_at").cast("date"))
    early = F.col("ingested_at") <= F.lit(first_run_clock(first)).cast("timestamp_ntz")
    return [lambda part=part: lake.write_batches(part, root) for part in (raw.where(early), raw.where(~early))]


@query
def stream_window_daily(spark, sf_dir):
    """Days given out as the watermark closes them; the stream is stopped and taken up again."""
    root = scratch(spark, "lake")
    return _drain_in_parts(spark, _lake_parts(spark, sf_dir, root), lambda: live.closed_days(live.lake_stream(spark, root)))


@query
def stream_gapfill(spark, sf_dir):
    """The dense fact of all hours the watermark closed, from two streams drained in two parts."""
    root, slots = scratch(spark, "lake"), scratch(spark, "slots")
    first, last = testdata.hour_range(spark, sf_dir)
    noon = first_run_clock(first)
    devices = testdata.raw_traffic(spark, sf_dir).select(F.col("deviceid").alias("device_id")).distinct()

    def land_slots(a: datetime, b: datetime) -> None:
        every = F.explode(F.sequence(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"), hours(1)))
        devices.select("device_id", every.alias("processed_at")).write.mode("append").parquet(slots)

    early, late = _lake_parts(spark, sf_dir, root)
    parts = [lambda: (early(), land_slots(first, noon)), lambda: (late(), land_slots(noon + timedelta(hours=1), last))]
    spine = lambda: spark.readStream.schema("device_id string, processed_at timestamp_ntz").parquet(slots)
    return _drain_in_parts(spark, parts, lambda: live.filled_hours(spine(), live.lake_stream(spark, root)))


@query
def stg_quarantine(spark, sf_dir):
    """A feed with bad records: what could be typed, and why the rest was set aside."""
    landing, checked = scratch(spark, "feed"), scratch(spark, "quarantine")
    testdata.spoilt_feed(spark, sf_dir).write.text(landing)
    staging.write_quarantined(staging.quarantined(staging.read_permissive(spark, landing)), checked)
    return staging.read_quarantined(spark, checked).select("traffic_id", "device_id", "processed_at", "counted_cars", "average_speed", "reason", "is_good")


# --- features and model --------------------------------------------------------------


@query
def training_rows(spark, sf_dir):
    return features.training_rows(history(spark, sf_dir), today(spark, sf_dir))


@query
def base_features(spark, sf_dir):
    return base(spark, sf_dir)


@query
def time_features(spark, sf_dir):
    rows = base(spark, sf_dir)
    moment = F.struct("date", "hour").alias("at")
    return features.time_features(rows.select("*", moment)).select("*", "at.*").drop("at")


@query
def split_hash(spark, sf_dir):
    return features.split_marked(base(spark, sf_dir))


@query
def target_encode(spark, sf_dir):
    fitted = encode.fit_target_encoding(base(spark, sf_dir), "device_id", features.TARGET)
    return fitted.table


@query
def target_encode_smoothed(spark, sf_dir):
    fitted = encode.fit_target_encoding(base(spark, sf_dir), "device_id", features.TARGET, smoothing=10)
    return fitted.table


@query
def target_encode_folds(spark, sf_dir):
    fold = encode.fold_of(*features.row_key())
    return encode.cross_fit_target_encoding(base(spark, sf_dir), "device_id", features.TARGET, fold, "device_code")


@query
def ordinal_encode(spark, sf_dir):
    """Codes of roads in the month's gold, fitted on the roads of its first half."""
    mart = gold(spark, sf_dir)
    fitted = encode.fit_ordinal_encoding(mart.where("road_name < 'Κ'"), "road_name")
    return encode.apply_ordinal_encoding(mart.select("road_name").distinct(), fitted, "road_name", "road_code")


@query
def ordinal_encode_devices(spark, sf_dir):
    """Codes of all devices of the long history, fitted on the training part."""
    fitted = encode.fit_ordinal_encoding(parts(spark, sf_dir)[0], "device_id")
    return encode.apply_ordinal_encoding(history(spark, sf_dir).select("device_id").distinct(), fitted, "device_id", "device_code")


@query
def road_devices(spark, sf_dir):
    return features.road_devices(gold(spark, sf_dir))


@query
def road_map(spark, sf_dir):
    lists = features.road_device_lists(features.road_devices(gold(spark, sf_dir)))
    return lists.select("road_name", F.array_join("devices", ",").alias("devices"), F.size("devices").alias("n_devices"))


#: Fewer trees than configured, as every further tree waits for the one before, and smaller leaves,
#: so that small tables grow trees as well.
TRIAL_MODEL = training.ModelSettings(max_iter=12, min_samples_leaf=50)


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training and test part."""
    marked = features.split_marked(base(spark, sf_dir))
    return marked.where("NOT is_test").drop("is_test"), marked.where("is_test").drop("is_test")


def lesson(rows: DataFrame) -> DataFrame:
    """``rows`` with speeds that follow the clock and the device, the given ones as noise: those
    alone hold nothing a model could learn."""
    speed = F.col("prediction") + (F.col(features.TARGET) - 70) / 10
    return closed_form(rows).withColumn(features.TARGET, published(speed)).drop("prediction")


def lessons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    train, test = parts(spark, sf_dir)
    return lesson(train), lesson(test)


def trained(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the model a training run saves, once per session."""

    def make() -> str:
        train = cut(lessons(spark, sf_dir)[0])
        model = training.fit(train, TRIAL_MODEL)
        return training.save(model, train, base(spark, sf_dir), scratch(spark, "models"), version=1)

    return _once("model", spark, sf_dir, make)


def loaded(spark: SparkSession, sf_dir: str) -> training.SpeedModel:
    return training.load(spark, trained(spark, sf_dir), TRIAL_MODEL)


@query
def gbt_metrics(spark, sf_dir):
    """Error of the fitted model, as loaded again, on the test part."""
    return training.metrics(loaded(spark, sf_dir).predict(lessons(spark, sf_dir)[1]))


@query
def gbt_splits(spark, sf_dir):
    """A tree of three leaves: both splits with their gain, sides and the means of their speeds."""
    rows = features.time_features(lesson(base(spark, sf_dir)).select("*", F.col("hour").alias("slot")))
    codes = cut(encode.fit_ordinal_encoding(rows, "road_name"))
    coded = cut(encode.apply_ordinal_encoding(rows, codes, "road_name", "road"))
    settings = boosting.BoostSettings(trees=1, leaves=3, rate=1.0, least_rows=5)
    model = boosting.fit(coded, features.TARGET, ["slot", "day_id", "processed_month"], {"road": codes.count()}, settings)
    named = model.binning
    bounds = spark.createDataFrame(
        [(j, name, None if e is None else e.tolist()) for j, (name, e) in enumerate(zip(named.names, named.edges))], "feature int, name string, edges array<double>"
    )
    nodes = boosting.nodes(model, spark)
    side = lambda which: nodes.select(F.col("node").alias(which), F.col("rows").alias(f"n_{which}"), (F.col("value") + model.base).alias(f"{which}_mean"))
    sent_left = nodes.select("node", F.explode("sides").alias("code")).join(codes, "code").groupBy("node").agg(
        F.array_join(F.array_sort(F.collect_list("road_name")), ",").alias("left_roads")
    )
    return (
        nodes.where("feature >= 0").join(bounds, "feature").join(side("left"), "left").join(side("right"), "right").join(sent_left, "node", "left")
        .select(
            (F.col("node") > 0).cast("int").alias("step"), F.col("name").alias("feature"), F.get("edges", F.col("threshold")).alias("threshold"),
            "left_roads", "gain", "n_left", "n_right", "left_mean", "right_mean",
        )
    )


@query
def model_holdout(spark, sf_dir):
    """The fitted model beside the mean of the training part."""
    return training.holdout(loaded(spark, sf_dir), *lessons(spark, sf_dir))


@query
def model_metrics(spark, sf_dir):
    return training.metrics(closed_form(parts(spark, sf_dir)[1]))


def model_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks for a road of the long history; some for an unknown road or hour."""
    return testdata.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        (F.col("user_id") % 30).cast("string").alias("road_name"),
        F.col("ts").cast("date").alias("target_date"),
        (F.get_json_object("props", "$.k").cast("int") % 30).alias("target_hour"),
    )


@query
def model_answers(spark, sf_dir):
    """What became of every request to the fitted model: an answer, or the reason for none."""
    asked = model_requests(spark, sf_dir)
    pairs = training.load_road_devices(spark, trained(spark, sf_dir))
    answers = scoring.score_roads(asked, pairs, loaded(spark, sf_dir).predict)
    plausible = F.col("average_predicted_speed_kmh").between(0, 130)
    answered = answers.select("request_id", "target_datetime", "active_devices_used", plausible.alias("is_plausible"))
    refused = scoring.rejected(asked, pairs).select("request_id", "reason")
    return answered.unionByName(refused, allowMissingColumns=True)


def requests(spark, sf_dir) -> DataFrame:
    """Every event asks for the speed on its road; some for an unknown road or hour."""
    events = testdata.table(spark, sf_dir, "events")
    named = events.select(
        F.col("event_id").alias("request_id"),
        "event_type",
        testdata.road_of(F.col("user_id")).alias("raw_name"),
        testdata.road_of(F.col("user_id")).alias("road_name"),
        F.col("ts").cast("date").alias("target_date"),
        (F.get_json_object("props", "$.k").cast("int") % 30).alias("target_hour"),
    )
    known = roads.normalise_roads(named)
    return known.withColumn("road_name", F.when(F.col("event_type") == "view", F.col("raw_name")).otherwise(F.col("road_name"))).drop(
        "raw_name", "event_type"
    )


@query
def road_scoring(spark, sf_dir):
    pairs = features.road_devices(gold(spark, sf_dir))
    answers = scoring.score_roads(requests(spark, sf_dir), pairs, closed_form)
    return answers.select("request_id", "road_name", "target_datetime", "average_predicted_speed_kmh", "active_devices_used")


@query
def road_breakdown(spark, sf_dir):
    pairs = features.road_devices(gold(spark, sf_dir))
    return scoring.device_answers(scoring.device_predictions(requests(spark, sf_dir), pairs, closed_form))


@query
def road_rejects(spark, sf_dir):
    pairs = features.road_devices(gold(spark, sf_dir))
    return scoring.rejected(requests(spark, sf_dir), pairs).select("request_id", "reason")


@query
def residual_hist(spark, sf_dir):
    residuals = scored(spark, sf_dir).withColumn("residual", F.col("average_speed") - F.col("prediction"))
    return bins.density_histogram(residuals, "residual", 50)


@query
def density_hex(spark, sf_dir):
    return bins.hexagon_density(scored(spark, sf_dir), "average_speed", "prediction", 75)


@query
def scatter_sample(spark, sf_dir):
    points = features.sample_rows(scored(spark, sf_dir), 1000, features.row_key())
    return points.select("device_id", "date", "hour", "average_speed", "prediction")


@query
def scatter_points(spark, sf_dir):
    """Every point of the scatter plot, as rows for whatever draws it."""
    return scored(spark, sf_dir).select("device_id", "date", "hour", "average_speed", "prediction")


@query
def latest_run(spark, sf_dir):
    """Every event as a registered model version and run."""
    runs = testdata.table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"),
        F.col("event_id").cast("string").alias("version"),
        F.col("ts").alias("start_time"),
    )
    newest = training.latest_run(runs).select(F.col("run_id").alias("newest_run"), "start_time")
    return training.latest_version(runs).select(
        F.col("run_id").alias("model_run"), "version", newest.select("newest_run").scalar().alias("newest_run")
    )


# --- drift ---------------------------------------------------------------------------


@query
def reference_sample(spark, sf_dir):
    """The sample of bounded size, drawn exactly, that a training run keeps by default."""
    return stored_reference(spark, sf_dir, training.ModelSettings())


@query
def shared_columns(spark, sf_dir):
    reference, _ = reference_and_current(spark, sf_dir)
    return monitoring.comparable(reference, features.recent(history(spark, sf_dir), today(spark, sf_dir), 14))


@query
def drift_numeric(spark, sf_dir):
    return drift.numeric_drift(*reference_and_current(spark, sf_dir), "average_speed")


@query
def drift_categorical(spark, sf_dir):
    return drift.categorical_drift(*reference_and_current(spark, sf_dir), ["device_id", "road_name"])


@query
def drift_summary(spark, sf_dir):
    return monitoring.drift_report(*reference_and_current(spark, sf_dir))[1]


@query
def drift_pvalues(spark, sf_dir):
    """Tests of significance beside the distances; alpha is 0.05."""
    return drift.drift_tests(*reference_and_current(spark, sf_dir), ["average_speed"], ["device_id", "road_name"])
