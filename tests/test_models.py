"""Staging, dimension, facts and gold on small inputs."""

from datetime import date, datetime, timedelta

import pytest
from compare import SF_DIR
from pyspark.sql import functions as F

from hodos.functions.calendar import clock, day_name, greek_holidays, hour_spine, month_spans, reporting_day
from hodos.operators import quality
from hodos.operators.quality import DataTestError
from hodos.plans import build, dashboard, facts, marts, reporting, roads, staging, states
from hodos.sources import testdata
from hodos.sources.tables import DIM_ROADS, FCT_MEASUREMENTS, MRT_TRAFFIC_ROAD, STG_TRAFFIC, Warehouse

START = datetime(2024, 1, 1)


def at(hour):
    return START + timedelta(hours=hour)


RAW = "deviceid string, appprocesstime string, countedcars long, average_speed double, road_name string, road_info string, ingested_at timestamp_ntz, year int, month int"


def raw(spark, *rows):
    """(device, hour, cars, speed, ingestion hour[, road])"""
    full = []
    for device, hour, cars, speed, ingested, *road in rows:
        moment = at(hour) if hour is not None else None
        full.append((device, moment and str(moment), cars, speed, road[0] if road else "R", "i", None if ingested is None else at(ingested), 2024, moment.month if moment else 1))
    return spark.createDataFrame(full, RAW)


def test_typed_accepts_iso_text_and_keeps_it_in_the_key(spark):
    one = raw(spark, ("MS1", 3, 5, 50.0, 30)).withColumn("appprocesstime", F.lit("2024-01-01T03:00:00Z"))
    row = staging.stage(one).first()
    assert (row.traffic_id, row.processed_at, row.processed_date) == ("MS1-2024-01-01T03:00:00Z", at(3), date(2024, 1, 1))


def test_bad_casts_stop_the_job(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|invalid"):
        staging.stage(raw(spark, ("MS1", 3, 5, 50.0, 30)).withColumn("appprocesstime", F.lit("yesterday"))).collect()


def test_the_latest_delivery_of_a_reading_counts(spark):
    staged = staging.stage(raw(spark, ("a", 1, 5, 50.0, 10), ("a", 1, 6, 40.0, 20), ("a", 1, 7, 30.0, None), ("b", 1, 1, 1.0, 10)))
    assert {(r.device_id, r.counted_cars) for r in staged.collect()} == {("a", 6), ("b", 1)}


def test_dedup_limits_groups_before_the_shuffle(spark):
    plan = staging.stage(raw(spark, ("a", 1, 5, 50.0, 10)))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_road_names(spark):
    staged = staging.stage(raw(spark, ("a", 1, 1, 1.0, 10, "Λ. ΚΗΦΙΣΙΑΣ"), ("a", 2, 1, 1.0, 20, "Π. ΡΑΛΛΗ"), ("b", 1, 1, 1.0, 10, "ΠΕΙΡΑΙΩΣ"), ("c", 1, 1, 1.0, 10, None)))
    found = {r.device_id: r.road_name for r in roads.latest_roads(staged).collect()}
    assert found == {"a": "ΠΕΤΡΟΥ ΡΑΛΛΗ", "b": "ΠΕΙΡΑΙΩΣ", "c": None}
    assert len(roads.ROAD_ALIASES) == 17


FLAGS = [  # cars, speed, ingested, ghost, dead, impossible, missing, quality
    (10, 50.0, 1, False, False, False, False, True),
    (0, 50.0, 1, True, False, False, False, False),
    (10, 0.0, 1, True, False, False, False, False),
    (0, 0.0, 1, False, True, False, False, False),
    (10, 131.0, 1, False, False, True, False, False),
    (10, 130.0, 1, False, False, False, False, True),
    (None, None, None, False, False, False, True, False),
    (None, 50.0, 1, False, False, False, False, False),
    (10, None, 1, False, False, False, False, True),
    (10, 50.0, None, False, False, False, True, False),
]


def test_flag_truth_table(spark):
    staged = staging.stage(raw(spark, *[(f"d{i}", 0, cars, speed, seen) for i, (cars, speed, seen, *_) in enumerate(FLAGS)]))
    fact = facts.measurements(staged, roads.latest_roads(staged), at(0), at(0))
    got = {r.device_id: (r.is_ghost_reading, r.is_dead, r.is_impossible_speed, r.is_missing, r.is_quality) for r in fact.collect()}
    assert got == {f"d{i}": tuple(row[3:]) for i, row in enumerate(FLAGS)}


def brute_force(staged, devices, first, last):
    found = {(r.device_id, r.processed_at): r for r in staged.collect()}
    slots = [first + timedelta(hours=i) for i in range(int((last - first).total_seconds() // 3600) + 1)]
    rows = []
    for d in devices.collect():
        for slot in slots:
            r = found.get((d.device_id, slot)) if d.device_id is not None else None
            rows.append((d.device_id, slot, r and r.ingested_at, r and r.counted_cars, r and r.average_speed))
    return sorted(rows, key=str)


@pytest.mark.parametrize("build_fact", [facts.measurements, facts.measurements_by_day])
def test_dense_grid_equals_brute_force(spark, build_fact):
    first, last = at(-30), at(24 * 33)  # over two month ends
    staged = staging.stage(
        raw(spark, ("a", 0, 1, 1.0, 1), ("a", 1, 2, 2.0, 2), ("a", 50, 3, 3.0, 60), ("b", 24 * 33, 4, 4.0, 1),
            ("c", -30, 5, 5.0, 1), ("d", 24 * 40, 6, 6.0, 1), ("e", 0.5, 7, 7.0, 1), (None, 3, 8, 8.0, 1))
    )
    devices = roads.latest_roads(staged)
    got = build_fact(staged, devices, first, last)
    rows = sorted([(r.device_id, r.processed_at, r.ingested_at, r.counted_cars, r.average_speed) for r in got.collect()], key=str)
    assert rows == brute_force(staged, devices, first, last)
    assert got.count() == devices.count() * ((33 * 24) + 31)


def test_readings_of_unknown_devices_stay_out(spark):
    staged = staging.stage(raw(spark, ("a", 0, 1, 1.0, 1), ("x", 0, 1, 1.0, 1)))
    known = roads.latest_roads(staged).where("device_id = 'a'")
    assert {r.device_id for r in facts.measurements(staged, known, at(0), at(3)).collect()} == {"a"}


def test_calendar_columns(spark):
    row = spark.sql("SELECT timestamp_ntz'2024-03-25 16:05:00' AS t").select(day_name(F.col("t")), clock(F.col("t"))).first()
    assert tuple(row) == ("Monday", "16:05")


def test_counts_of_the_adapter(spark):
    staged = staging.stage(testdata.raw_traffic(spark, SF_DIR))
    first, last = testdata.hour_range(spark, SF_DIR)
    fact = facts.measurements(staged, roads.latest_roads(staged), first, last)
    flags = ("is_ghost_reading", "is_dead", "is_impossible_speed", "is_missing", "is_quality")
    row = fact.agg(F.count("*"), *[F.count_if(f) for f in flags]).first()
    assert tuple(row) == (10800, 206, 1, 53, 9849, 692)
    assert staged.count() == 951


def test_shortcuts_equal_the_dense_fact(spark):
    staged = staging.stage(testdata.raw_traffic(spark, SF_DIR)).persist()
    devices, (first, last) = roads.latest_roads(staged), testdata.hour_range(spark, SF_DIR)
    dense = facts.measurements(staged, devices, first, last)
    rows = lambda df: sorted(map(str, df.collect()))
    observed = facts.observed_measurements(staged, first, last)
    assert rows(marts.traffic_road(observed, devices)) == rows(marts.traffic_road(dense, devices))
    spans = facts.measured_spans(staged, devices, first, last)
    assert rows(marts.device_health(spans, weight="hours")) == rows(marts.device_health(dense))
    staged.unpersist()


# --- windows and reports -------------------------------------------------------------


def gold(spark, *rows):
    """(device, road, day offset, hour, cars, speed)"""
    return spark.createDataFrame(
        [(d, r, START + timedelta(days=day, hours=h), c, s) for d, r, day, h, c, s in rows],
        "device_id string, road_name string, processed_at timestamp_ntz, counted_cars long, average_speed double",
    ).selectExpr("*", "cast(processed_at as date) processed_date", "year(processed_at) processed_year", "month(processed_at) processed_month",
                 "date_format(processed_at, 'EEEE') processed_day", "date_format(processed_at, 'HH:mm') processed_hour")


def test_windows_hold_31_and_30_dates(spark):
    mart = gold(spark, *[("a", "R", day, 23, 1, 1.0) for day in range(100)])
    days = lambda df: sorted((r.processed_date - START.date()).days for r in df.collect())
    assert days(marts.last_days(mart)) == list(range(69, 100))
    assert days(marts.previous_days(mart)) == list(range(39, 69))


def test_weighted_speed_ignores_null_speeds_in_the_numerator_only(spark):
    mart = gold(spark, ("a", "R", 0, 1, 10, 50.0), ("a", "R", 0, 2, 30, 10.0), ("b", None, 0, 1, 10, None))
    row = reporting.kpi(mart).first()
    assert (row.weighted_avg_speed, row.sum_counted_cars, row.distinct_roads_count, row.distinct_devices_count) == (16.0, 50, 1, 2)
    assert row.latest_timestamp == START + timedelta(hours=2)


def test_no_cars_means_no_speed(spark):
    assert reporting.kpi(gold(spark, ("a", "R", 0, 1, 0, 50.0))).first().weighted_avg_speed is None


def test_extremes_keep_ties_and_a_single_slot(spark):
    tied = gold(spark, ("a", "R", 0, 1, 1, 10.0), ("a", "R", 0, 2, 1, 10.0), ("a", "R", 0, 3, 1, 90.0), ("a", "R", 0, 4, 1, 50.0))
    assert sorted((r.processed_hour, r.slot) for r in reporting.labelled_times(tied).collect()) == [("01:00", "busiest"), ("02:00", "busiest"), ("03:00", "lightest")]
    assert reporting.busiest_times(gold(spark, ("a", "R", 0, 1, 1, 10.0))).count() == 1


def test_period_comparison(spark):
    mart = gold(spark, ("a", "R", 0, 1, 10, 20.0), ("a", "R", 40, 1, 30, 50.0), ("b", "S", 40, 2, 10, 50.0))
    row = reporting.kpi_delta(reporting.kpi(marts.last_days(mart)), reporting.kpi(marts.previous_days(mart), with_time=False)).first()
    assert (row.delta_weighted_avg_speed, row.delta_sum_counted_cars, row.delta_distinct_roads_count, row.delta_distinct_devices_count) == (30.0, 30, 1, 1)


def test_one_pass_over_both_periods_equals_two_reports(spark):
    rows = [(d, r, day, h, 1 + (day * h) % 7, float(day % 11 * h)) for d, r in (("a", "R"), ("b", "R"), ("c", "S"), ("d", None)) for day in range(0, 100, 3) for h in (1, 9)]
    mart = gold(spark, *rows)
    totals = reporting.period_totals(marts.both_periods(mart))
    two = reporting.kpi_delta(reporting.kpi(marts.last_days(mart)), reporting.kpi(marts.previous_days(mart), with_time=False)).first()
    one = reporting.delta_of(reporting.period_figures(totals)).first()
    assert one.asDict() == pytest.approx(two.asDict())
    slots = lambda df: sorted((r.processed_day, r.processed_hour, round(r.weighted_avg_speed, 9)) for r in df.collect())
    assert slots(reporting.slots_of(totals)) == slots(reporting.speed_by_slot(marts.last_days(mart)))


def test_a_period_without_rows_counts_nothing(spark):
    mart = gold(spark, ("a", "R", 40, 1, 30, 50.0))
    row = reporting.delta_of(reporting.period_figures(reporting.period_totals(marts.both_periods(mart)))).first()
    assert (row.previous_distinct_roads_count, row.previous_weighted_avg_speed, row.distinct_devices_count) == (0, None, 1)


def test_outputs_come_in_their_order(spark):
    mart = gold(spark, *[("a", road, day, h, 1, float(h * day)) for road in ("Y", None, "X") for day in (3, 0, 1) for h in (9, 2)])
    last = lambda name: (name is None, name or "")
    slots = [(last(r.road_name), r.processed_day, r.processed_hour) for r in dashboard.spatiotemporal(mart).collect()]
    hourly = [(last(r.road_name), r.processed_hour) for r in dashboard.speed_count(mart).collect()]
    assert slots == sorted(slots) and len(slots) == 18 and hourly == sorted(hourly) and len(hourly) == 6
    assert [r.road_name for r in dashboard.by_road(dashboard.volatility(mart)).collect()] == ["X", "Y", None]


def test_volatility_ranking_puts_single_readings_last(spark):
    mart = gold(spark, ("a", "X", 0, 1, 1, 10.0), ("a", "X", 0, 2, 1, 30.0), ("a", "Y", 0, 1, 1, 10.0), ("a", "Z", 0, 1, 1, 10.0), ("a", "Z", 0, 2, 1, 12.0))
    ranked = dashboard.volatility(mart)
    names = lambda df: [r.road_name for r in df.collect()]
    assert names(dashboard.longest_first(ranked)) == ["X", "Z", "Y"]
    assert names(dashboard.most_volatile(ranked, 2)) == ["X", "Z"]
    assert names(dashboard.least_volatile(ranked, 2)) == ["Z", "Y"]


def test_top_k_is_not_a_full_sort(spark):
    plan = dashboard.most_volatile(dashboard.volatility(gold(spark, ("a", "X", 0, 1, 1, 1.0))))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_selection_and_chart_forms(spark):
    mart = gold(spark, ("a", "X", 0, 1, 1, 10.0), ("a", "Y", 6, 2, 1, 30.0), ("a", "X", 6, 2, 1, 50.0))
    slots = dashboard.spatiotemporal(mart)
    assert dashboard.for_roads(slots, []).count() == 3 and dashboard.for_roads(slots, ["Y"]).count() == 1
    assert [r.road_name for r in dashboard.road_choices(mart).collect()] == ["X", "Y"]
    cells = [(r.processed_day, r.mean_speed) for r in dashboard.heatmap_cells(slots).collect()]
    assert cells == [("Monday", 10.0), ("Sunday", 40.0)]
    assert dashboard.heatmap_matrix(slots).columns[1:] == ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def test_reporting_day_rolls_over_at_six(spark):
    moments = ["04:00", "05:12", "05:59", "06:00", "06:01", "14:00"]
    df = spark.createDataFrame([(f"2024-11-02 {m}:00",) for m in moments], "t string").select(reporting_day(F.col("t")).alias("d"))
    assert [str(r.d) for r in df.collect()] == ["2024-11-01"] * 3 + ["2024-11-02"] * 3


def test_months_of_a_range(spark):
    spans = [(str(r.first_day), str(r.last_day)) for r in month_spans(spark, date(2024, 1, 30), date(2024, 3, 2)).collect()]
    assert spans == [("2024-01-30", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-02")]


def test_easter_dates(spark):
    found = {(r.holiday_date, r.holiday_name) for r in greek_holidays(spark, 2023, 2025).collect()}
    for day in (date(2023, 4, 17), date(2024, 5, 6), date(2025, 4, 21)):
        assert (day, "Easter Monday") in found
    assert (date(2024, 3, 18), "Clean Monday") in found and (date(2024, 3, 25), "Independence Day") in found
    assert len(found) == 36


# --- incremental ---------------------------------------------------------------------


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


STG_COLUMNS = ("traffic_id", "counted_cars", "average_speed", "ingested_at")


def test_batches_equal_a_full_rebuild_when_nothing_is_late(spark, folder):
    """Three daily runs against one full one, and a repeated run changes nothing."""
    everything = raw(spark, *[(f"d{i % 3}", h, h % 7, float(h), h - h % 24 + 29) for i, h in enumerate(range(0, 72))])
    grown, full = Warehouse(spark, f"{folder}/grown"), Warehouse(spark, f"{folder}/full")
    for day in (1, 2, 3, 3):
        now = at(day * 24 + 5)
        build.run(grown, everything.where(F.col("ingested_at") <= F.lit(now).cast("timestamp_ntz")), as_of=now, spine_start=START)
    build.run(full, everything, as_of=at(77), full=True, spine_start=START)
    for table in (STG_TRAFFIC, DIM_ROADS, FCT_MEASUREMENTS, MRT_TRAFFIC_ROAD):
        columns = [c for c in full.read(table).columns]
        assert rows(grown.read(table), *columns) == rows(full.read(table), *columns), table.name
    assert full.read(FCT_MEASUREMENTS).count() == 3 * 78
    assert {k: v.count() for k, v in build.homepage_tables(grown).items()} == {"busiest_times": 2, "daily_speed_count": 3, "last_kpi": 1, "previous_kpi": 1}


def test_late_readings_miss_the_fact_until_a_full_rebuild(spark, folder):
    warehouse = Warehouse(spark, folder)
    early = raw(spark, ("a", 0, 1, 1.0, 10), ("a", 200, 2, 2.0, 205))
    build.run(warehouse, early, as_of=at(205), spine_start=START, gold=False)
    late = early.unionByName(raw(spark, ("a", 5, 3, 3.0, 210), ("a", 205 - 48, 4, 4.0, 210), ("a", 205 - 47, 5, 5.0, 210)))
    second = build.run(warehouse, late, as_of=at(220), spine_start=START, gold=False)
    assert second.bound == at(205 - 48)
    # The reading exactly at the bound is late as well: its hour is settled.
    assert sorted(r.processed_at for r in second.late.collect()) == [at(5), at(205 - 48)]
    found = {r.processed_at for r in warehouse.read(FCT_MEASUREMENTS).where("NOT is_missing").collect()}
    assert found == {at(0), at(200), at(205 - 47)}
    assert warehouse.read(FCT_MEASUREMENTS).count() == 221
    build.run(warehouse, late, as_of=at(220), full=True, spine_start=START, gold=False)
    assert warehouse.read(FCT_MEASUREMENTS).where("NOT is_missing").count() == 5


def test_anchoring_on_data_survives_an_outage(spark, folder):
    def second_run(anchor):
        warehouse = Warehouse(spark, f"{folder}/{anchor}")
        first = raw(spark, ("a", 0, 1, 1.0, 10))
        build.run(warehouse, first, as_of=at(300), spine_start=START, gold=False)
        more = first.unionByName(raw(spark, ("a", 20, 2, 2.0, 301)))
        build.run(warehouse, more, as_of=at(302), spine_start=START, anchor=anchor, gold=False)
        return warehouse.read(FCT_MEASUREMENTS).where("NOT is_missing").count()

    assert (second_run("spine"), second_run("data")) == (1, 2)


def test_a_new_device_gets_no_settled_hours(spark, folder):
    warehouse = Warehouse(spark, folder)
    first = raw(spark, ("a", 0, 1, 1.0, 10))
    build.run(warehouse, first, as_of=at(100), spine_start=START, gold=False)
    build.run(warehouse, first.unionByName(raw(spark, ("b", 101, 2, 2.0, 110))), as_of=at(110), spine_start=START, gold=False)
    counts = {r.device_id: r["count"] for r in warehouse.read(FCT_MEASUREMENTS).groupBy("device_id").count().collect()}
    assert counts == {"a": 111, "b": 110 - 52}


def test_a_later_delivery_replaces_the_staged_row(spark, folder):
    warehouse = Warehouse(spark, folder)
    first = raw(spark, ("a", 0, 1, 1.0, 10, "Λ. ΚΗΦΙΣΟΥ"), ("b", 0, 1, 1.0, 10))
    build.run(warehouse, first, as_of=at(12), spine_start=START, gold=False)
    build.run(warehouse, first.unionByName(raw(spark, ("a", 0, 9, 9.0, 11, "Λ. ΣΥΓΓΡΟΥ"))), as_of=at(12), spine_start=START, gold=False)
    assert {(r.device_id, r.counted_cars) for r in warehouse.read(STG_TRAFFIC).collect()} == {("a", 9), ("b", 1)}
    assert {(r.device_id, r.road_name) for r in warehouse.read(DIM_ROADS).collect()} == {("a", "ΣΥΓΓΡΟΥ"), ("b", "R")}


def test_upsert_touches_only_partitions_of_the_batch(spark, folder):
    warehouse = Warehouse(spark, folder)
    warehouse.replace(STG_TRAFFIC, staging.stage(raw(spark, ("a", 0, 1, 1.0, 10), ("a", 24 * 31, 1, 1.0, 10))))
    january = f"{warehouse.path(STG_TRAFFIC)}/day=2024-01-01"
    files = lambda: [r.path for r in spark.read.format("binaryFile").load(january).select("path").collect()]
    before = files()
    batch = staging.stage(raw(spark, ("a", 24 * 31, 5, 5.0, 20), ("b", 24 * 31, 6, 6.0, 20)))
    warehouse.upsert(STG_TRAFFIC, batch, staging.KEY)
    assert files() == before
    assert sorted(r.counted_cars for r in warehouse.read(STG_TRAFFIC).collect()) == [1, 5, 6]


def test_an_interrupted_merge_is_repeated(spark, folder, monkeypatch):
    warehouse = Warehouse(spark, folder)
    warehouse.replace(STG_TRAFFIC, staging.stage(raw(spark, ("a", 0, 1, 1.0, 10))))

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(Warehouse, "_publish_merge", crash)
        with pytest.raises(RuntimeError):
            warehouse.upsert(STG_TRAFFIC, staging.stage(raw(spark, ("b", 0, 2, 2.0, 20))), staging.KEY)
    devices = lambda: sorted(r.device_id for r in Warehouse(spark, folder).read(STG_TRAFFIC).collect())
    assert devices() == ["a"]  # a reader must not publish: the writer may still be at it
    warehouse.upsert(STG_TRAFFIC, staging.stage(raw(spark, ("c", 0, 3, 3.0, 30))), staging.KEY)
    assert devices() == ["a", "b", "c"]


def test_two_spellings_of_one_time_are_one_reading(spark, folder):
    first = raw(spark, ("a", 1, 1, 1.0, 10), ("b", 1, 5, 5.0, 10))
    second = raw(spark, ("a", 1, 2, 2.0, 20)).withColumn("appprocesstime", F.concat(F.replace("appprocesstime", F.lit(" "), F.lit("T")), F.lit("Z")))
    warehouse = Warehouse(spark, folder)
    for now in (first, first.unionByName(second)):
        build.run(warehouse, now, as_of=at(3), spine_start=START, gold=False)
    assert sorted((r.device_id, r.counted_cars) for r in warehouse.read(STG_TRAFFIC).collect()) == [("a", 2), ("b", 5)]
    keys = warehouse.read(FCT_MEASUREMENTS).groupBy("device_id", "processed_at").count()
    assert keys.where("count > 1").isEmpty()


def test_an_incremental_run_reads_touched_days_only(spark, folder):
    """Days that a run does not touch are made unreadable: tests and reports still come out right."""
    early = raw(spark, *[(f"d{i}", h, h % 7 + 1, float(h % 50 + 3), h - h % 24 + 29) for i in range(3) for h in range(0, 240, 5)])
    more = early.unionByName(raw(spark, *[(f"d{i}", 241, 4, 40.0, 269) for i in range(3)]))
    warehouse, whole = Warehouse(spark, f"{folder}/grown"), Warehouse(spark, f"{folder}/whole")
    build.run(warehouse, early, as_of=at(245), spine_start=START, gold=False)
    for table in (STG_TRAFFIC, FCT_MEASUREMENTS):
        for day in range(1, 6):
            spoilt = f"{warehouse.path(table)}/day=2024-01-0{day}"
            files = [r.path for r in spark.read.format("binaryFile").load(spoilt).select("path").collect()]
            for path in files:
                with open(path.removeprefix("file:"), "wb") as out:
                    out.write(b"spoilt")
    run = build.run(warehouse, more, as_of=at(270), spine_start=START, gold=False)
    assert run.bound == at(245 - 48)
    build.run(whole, more, as_of=at(270), spine_start=START, gold=False)
    for of in (states.figures, states.daily_speed_count, states.busiest_times, states.device_health):
        got, want = of(warehouse), of(whole)
        assert rows(got, *want.columns) == rows(want, *want.columns), of.__name__
    tests = lambda w: build.kept_tests(w, START, at(270))
    columns = ("table_name", "column_name", "test_name", "failing_rows", "status")
    assert rows(tests(warehouse), *columns) == rows(tests(whole), *columns)
    assert states.estimated_devices(warehouse, date(2024, 1, 1), date(2024, 1, 31)).first().devices == 3
    assert states.mark(warehouse) == at(269)


def test_states_agree_with_tests_and_reports_over_all_rows(spark, folder):
    warehouse = Warehouse(spark, folder)
    odd = raw(spark, ("a", 0, None, 5.0, 3), ("a", 1, 3, None, 3), ("a", 2, 0, 0.0, 3), ("b", 2, 4, 200.0, 3), ("b", 3, 4, 20.0, 3), ("c", 30, 2, 60.0, 40))
    build.run(warehouse, odd, as_of=at(50), spine_start=START, gold=False, gate=False)
    staged, devices, measured = (warehouse.read(t) for t in (STG_TRAFFIC, DIM_ROADS, FCT_MEASUREMENTS))
    columns = ("table_name", "column_name", "test_name", "failing_rows", "status")
    slots = hour_spine(spark, START, at(50))
    want = quality.report(build.silver_tests(staged, devices) + build.fact_tests(slots, measured, devices))
    assert rows(build.kept_tests(warehouse, START, at(50)), *columns) == rows(want, *columns)
    mart = marts.traffic_road(measured, devices)
    assert rows(states.kpi(warehouse), "*") == rows(reporting.kpi(marts.last_days(mart)), "*")
    assert rows(states.busiest_times(warehouse), "*") == rows(reporting.busiest_times(marts.last_days(mart)), "*")
    assert rows(states.device_health(warehouse), "*") == rows(marts.device_health(measured), "*")


def test_a_failed_data_test_stops_the_run(spark, folder):
    warehouse, bad = Warehouse(spark, folder), raw(spark, ("a", 0, None, 5.0, 3))
    with pytest.raises(DataTestError, match="stg_traffic.counted_cars not_null: 1"):
        build.run(warehouse, bad, as_of=at(5), spine_start=START)
    assert warehouse.exists(STG_TRAFFIC) and not warehouse.exists(FCT_MEASUREMENTS)
    build.run(warehouse, bad, as_of=at(5), spine_start=START, gold=False, gate=False)
    assert warehouse.exists(FCT_MEASUREMENTS)


def test_an_empty_target_takes_everything(spark, folder):
    warehouse = Warehouse(spark, folder)
    empty = raw(spark, ("a", 0, 1, 1.0, 10)).limit(0)
    build.run(warehouse, empty, as_of=at(5), spine_start=START, gold=False)
    build.run(warehouse, raw(spark, ("a", 4, 1, 1.0, 10)), as_of=at(12), spine_start=START, gold=False)
    assert warehouse.read(FCT_MEASUREMENTS).where("NOT is_missing").count() == 1


def test_targets_are_separate(spark, folder):
    prod, dev = Warehouse(spark, folder), Warehouse(spark, folder, target="dev")
    prod.replace(DIM_ROADS, roads.latest_roads(staging.stage(raw(spark, ("a", 0, 1, 1.0, 10)))))
    assert prod.exists(DIM_ROADS) and not dev.exists(DIM_ROADS)


def test_freshness(spark):
    source = raw(spark, ("a", 0, 1, 1.0, 10))
    status = lambda h: build.freshness(source, at(10 + h)).first().status
    assert [status(h) for h in (24, 25, 36, 37)] == ["pass", "warn", "warn", "error"]
