"""Quarantine of bad records, tests of significance, and streams that agree with the batch."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hodos.operators import drift
from hodos.plans import facts, monitoring, roads, staging
from hodos.sources import lake
from hodos.streaming import live

START = datetime(2024, 1, 1)


def at(hour):
    return START + timedelta(hours=hour)


# --- quarantine --------------------------------------------------------------------------


def test_bad_records_are_set_aside_with_their_reasons(spark, folder):
    lines = [
        '{"deviceid": "a", "appprocesstime": "2024-01-01 03:00:00", "countedcars": 5, "average_speed": 50.5, "road_name": "R", "road_info": "i"}',
        '{"deviceid": "a", "appprocess',
        '{"deviceid": null, "appprocesstime": "soon", "countedcars": "many", "average_speed": "fast"}',
        '{"deviceid": "b", "appprocesstime": "2024-01-01T04:00:00Z"}',
        "[]",
    ]
    spark.createDataFrame([(line,) for line in lines], "value string").write.text(f"{folder}/feed")
    staging.write_quarantined(staging.quarantined(staging.read_permissive(spark, f"{folder}/feed")), f"{folder}/checked")
    got = staging.read_quarantined(spark, f"{folder}/checked")
    good = {r.device_id: (r.processed_at, r.counted_cars, r.average_speed, r.record) for r in got.where("is_good").collect()}
    assert good == {"a": (at(3), 5, 50.5, None), "b": (at(4), None, None, None)}
    bad = sorted((r.reason, r.record) for r in got.where("NOT is_good").collect())
    assert (bad[-1][0], bad[-1][1]) == ("malformed record", lines[1]) or ("malformed record", lines[1]) in bad
    faults = "deviceid is missing; appprocesstime is no timestamp_ntz; countedcars is no bigint; average_speed is no double"
    assert faults in [reason for reason, _ in bad]
    # the good rows go on as they are into the strict form
    assert got.where("is_good").select("device_id", "processed_at").distinct().count() == 2


def test_nothing_landed(spark, folder):
    spark.createDataFrame([], "value string").write.text(f"{folder}/feed")
    assert staging.quarantined(staging.read_permissive(spark, f"{folder}/feed")).count() == 0


# --- tests of significance ----------------------------------------------------------------


def test_log_gamma(spark):
    values = [0.5, 1.0, 1.5, 3.0, 10.25, 499.5, 1e5]
    got = [r.g for r in spark.createDataFrame([(v,) for v in values], "x double").select(drift.log_gamma(F.col("x")).alias("g")).collect()]
    assert got == pytest.approx([math.lgamma(v) for v in values], rel=1e-12, abs=1e-9)


@pytest.mark.parametrize(
    "statistic, freedom, p",
    # from the closed forms: two degrees exp(-x/2), four exp(-x/2)(1 + x/2), one erfc(sqrt(x/2))
    [(3.0, 2, math.exp(-1.5)), (40.0, 2, math.exp(-20)), (7.0, 4, math.exp(-3.5) * 4.5), (3.84, 1, math.erfc(math.sqrt(1.92))), (0.0, 5, 1.0), (2000.0, 4, 0.0), (5.0, 0, 1.0)],
)
def test_chi_square_p_values(spark, statistic, freedom, p):
    got = spark.range(1).select(drift.chi_square_p_value(F.lit(statistic), F.lit(freedom)).alias("p")).first().p
    assert got == pytest.approx(p, abs=1e-10)


def test_chi_square_with_many_degrees(spark):
    """Close to the normal law: half of it lies above the median."""
    median = 2000 * (1 - 2 / (9 * 2000)) ** 3
    got = spark.range(1).select(drift.chi_square_p_value(F.lit(median), F.lit(2000)).alias("p")).first().p
    assert got == pytest.approx(0.5, abs=1e-4)


def test_kolmogorov_p_values(spark):
    scaled = 1.3580986  # the five percent point of the limit law
    n = 10**8
    root = math.sqrt(n / 2)
    got = spark.range(1).select(drift.kolmogorov_p_value(F.lit(scaled / (root + 0.12 + 0.11 / root)), F.lit(n), F.lit(n)).alias("p")).first().p
    assert got == pytest.approx(0.05, abs=1e-6)
    assert spark.range(1).select(drift.kolmogorov_p_value(F.lit(0.0), F.lit(n), F.lit(n)).alias("p")).first().p == 1.0


def test_the_choice_of_test_follows_the_size(spark):
    side = lambda shift: spark.createDataFrame([(f"d{i % 3}", float(i % 20 + shift)) for i in range(200)], "device_id string, average_speed double")
    small = {r.column_name: (r.method, r.is_drifted) for r in monitoring.drift_by_size(side(0), side(8)).collect()}
    assert small == {"average_speed": ("kolmogorov_smirnov", True), "device_id": ("chi_square", False)}
    large = {r.column_name: (r.method, r.is_drifted) for r in monitoring.drift_by_size(side(0), side(8), tests_up_to=100).collect()}
    assert large == {"average_speed": ("wasserstein", True), "device_id": ("jensenshannon", False)}
    empty = drift.drift_tests(side(0), side(0).limit(0), ["average_speed"], ["device_id"]).collect()
    assert all(r.p_value is None and r.is_drifted is None for r in empty)


# --- streams -------------------------------------------------------------------------------


def drained(make, folder, *parts):
    progress = []
    for part in parts:
        part()
        frame = make()
        query = frame.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/offsets").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        progress += query.recentProgress
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/out"), progress


def test_filled_hours_equal_the_batch_and_forget_closed_ones(spark, folder):
    schema = "deviceid string, appprocesstime string, countedcars long, average_speed double, road_name string, road_info string, ingested_at timestamp_ntz"
    readings = [(f"d{h % 3}", str(at(h)), h % 6, float(h % 40), "R", "i", at(h + 5)) for h in range(0, 240, 7)]
    readings += [("d0", str(at(14)), 9, 9.0, "R", "i", at(20)), ("d1", str(at(21))[:-5] + "30:00", 1, 1.0, "R", "i", at(26))]  # a correction; not on the hour

    def land(rows):
        frame = spark.createDataFrame(rows, schema)
        lake.write_batches(frame.withColumn("date", F.col("appprocesstime").cast("date")), f"{folder}/lake")

    def slots(a, b):
        spark.createDataFrame([(f"d{i}", at(h)) for i in range(3) for h in range(a, b)], "device_id string, processed_at timestamp_ntz").write.mode("append").parquet(f"{folder}/slots")

    def make():
        spine = spark.readStream.schema("device_id string, processed_at timestamp_ntz").parquet(f"{folder}/slots")
        return live.filled_hours(spine, live.lake_stream(spark, f"{folder}/lake"))

    early, late = [r for r in readings if r[1] < str(at(120))], [r for r in readings if r[1] >= str(at(120))]
    got, progress = drained(make, folder, lambda: (land(early), slots(0, 120)), lambda: (land(late), slots(120, 240)))
    staged = staging.stage(lake.read_lake(spark, f"{folder}/lake"))
    closed = at(238 - 48)  # the newest reading is that of hour 238
    want = facts.measurements(staged, roads.latest_roads(staged), START, at(239)).where(F.col("processed_at") + F.expr("INTERVAL 1 HOUR") <= F.lit(closed))
    as_rows = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    assert as_rows(got) == as_rows(want) and want.where("is_missing").count() > 100
    left = sum(op["numRowsTotal"] for op in progress[-1]["stateOperators"])
    assert 0 < left < 3 * (49 + 3) * 4  # the open hours of two days, not all that went through


def test_filled_hours_keep_no_row_for_every_open_hour(spark, folder, monkeypatch):
    monkeypatch.setattr(live, "PARTS", 4, raising=False)
    schema = "deviceid string, appprocesstime string, countedcars long, average_speed double, road_name string, road_info string, ingested_at timestamp_ntz"
    row = lambda device, hour, cars, speed, ingested: (device, str(at(hour)), cars, speed, "R", "i", ingested)
    odd = [("a", 3, 2**60 + 1, 5.5, at(30)), ("a", 4, None, None, None), ("b", 3, 0, float("nan"), at(30)), ("b", 3, 0, None, at(30)), ("b", 4, 7, -1.0, None), ("b", 4, 8, 1.0, at(9)),
           ("b", 4, None, 1.0, at(9)), ("c", 5, 5, 2.0, at(9)), ("c", 5, 5, 1.0, at(9)), ("c", 5, 1, 9.0, at(8)), ("c", 119, 3, 3.0, at(130)), (None, 6, 4, 4.0, at(9)), ("no slot", 6, 4, 4.0, at(9))]
    devices = ["a", "b", "c", *(f"silent{i}" for i in range(60))]

    def land(rows):
        frame = spark.createDataFrame([row(*r) for r in rows], schema)
        lake.write_batches(frame.withColumn("date", F.coalesce("ingested_at", "appprocesstime").cast("date")), f"{folder}/lake")

    def slots(a, b):
        every = [(d, at(h)) for d in [*devices, None] for h in range(a, b)]
        spark.createDataFrame([*every, *every[:50], ("a", None), ("a", datetime(1969, 12, 31, 5))], "device_id string, processed_at timestamp_ntz").write.mode("append").parquet(f"{folder}/slots")

    def make():
        spine = spark.readStream.schema("device_id string, processed_at timestamp_ntz").parquet(f"{folder}/slots")
        return live.filled_hours(spine, live.lake_stream(spark, f"{folder}/lake"))

    late = [("a", 200, 1, 1.0, at(210)), ("c", 140, 2, 2.0, at(150)), ("a", 239, 1, 1.0, at(250)), ("b", 3, 99, 9.0, at(300))]  # the last one after its hour was closed
    got, progress = drained(make, folder, lambda: (land(odd), slots(0, 120)), lambda: (land(late), slots(120, 240)))
    staged = staging.stage(lake.read_lake(spark, f"{folder}/lake").where("coalesce(countedcars, 0) != 99"))
    known = spark.createDataFrame([(d,) for d in devices], "device_id string")
    closed = F.col("processed_at") + F.expr("INTERVAL 1 HOUR") <= F.lit(at(239 - 48))
    want = facts.measurements(staged, known, START, at(239)).where(closed)
    as_rows = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    assert as_rows(got.where("device_id IS NOT NULL")) == as_rows(want)
    nameless = got.where("device_id IS NULL")
    assert nameless.count() == nameless.where("is_missing").select("processed_at").distinct().count() == 191
    assert max(sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in progress) <= 4  # 64 devices, 49 open hours and more each
