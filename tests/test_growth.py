"""Steps whose memory or time grew faster than their input."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hodos.operators import quality
from hodos.plans import facts, scoring, states
from hodos.sources import lake
from hodos.sources.tables import FCT_MEASUREMENTS, Table, Warehouse

START = datetime(2024, 3, 1)
hour = lambda h, minutes=0: START + timedelta(hours=h, minutes=minutes)


def dense(spark, devices, n_hours, readings=()):
    """The fact of some devices; readings of (device, hour, cars)."""
    data = [(d, hour(h), cars, 50.0, hour(h + 29)) for d, h, cars in readings]
    staged = spark.createDataFrame(data, "device_id string, processed_at timestamp_ntz, counted_cars long, average_speed double, ingested_at timestamp_ntz")
    known = spark.createDataFrame([(d,) for d in devices], "device_id string")
    return facts.measurements_by_day(staged, known, START, hour(n_hours - 1))


def test_hourly_uniqueness_counts_the_same_keys(spark):
    rows = [("a", hour(0)), ("a", hour(1)), ("a", hour(1)), ("a", hour(23)), ("a", hour(23)), ("a", hour(23)), ("a", hour(47)), ("a", hour(1, 30))]
    rows += [("b", hour(5, 15)), ("b", hour(5, 15)), ("b", hour(5)), ("b", None), ("b", None), (None, hour(2)), (None, hour(2))]
    df = spark.createDataFrame(rows, "device_id string, processed_at timestamp_ntz")
    plain, hourly = quality.unique(df, "t", "device_id", "processed_at"), quality.unique_hourly(df, "t", "device_id", "processed_at")
    assert plain.collect() == hourly.collect() and hourly.first().failing_rows == 3
    assert quality.unique_hourly(df.where("false"), "t", "device_id", "processed_at").first().status == "pass"


def test_states_of_the_fact_hold_a_row_a_device_and_day(spark):
    rows = dense(spark, ["a", "b"], 72, [("a", 3, 5), ("b", 30, 7)])
    twice = rows.unionByName(rows.where("device_id = 'a' AND processed_at = TIMESTAMP_NTZ'2024-03-02 04:00:00'"))
    parts = states.device_parts(twice)
    assert parts.count() == 2 * 3
    days = {r.day: r for r in states.fact_days(parts, spark.createDataFrame([("a",)], "device_id string")).collect()}
    assert [(days[d].n_rows, days[d].n_repeated, days[d].n_orphans) for d in sorted(days)] == [(48, 0, 24), (49, 1, 24), (48, 0, 24)]
    assert days["2024-03-02"].newest_reading == hour(30) and days["2024-03-03"].newest_slot == hour(71)
    cars = {(r.day, r.device_id): (r.n_rows, r.n_quality, r.cars) for r in states.device_days(parts).collect()}
    assert cars["2024-03-01", "a"] == (24, 1, 5) and cars["2024-03-02", "b"] == (24, 1, 7) and cars["2024-03-02", "a"] == (25, 0, None)


def test_a_task_of_the_fact_makes_a_bounded_number_of_hours(spark, monkeypatch):
    monkeypatch.setattr(facts, "TASK_HOURS", 240)
    rows = dense(spark, [f"d{i}" for i in range(100)], 48, [("d1", 3, 5)])
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4800 and len(sizes) >= 18 and max(sizes) <= 24 * 25


def test_a_rewritten_range_keeps_the_other_hours(spark, folder):
    warehouse = Warehouse(spark, folder)
    warehouse.replace(FCT_MEASUREMENTS, dense(spark, ["a"], 72, [("a", 20, 1), ("a", 30, 2), ("a", 60, 3)]))
    files = lambda day: [r.path for r in spark.read.format("binaryFile").load(f"{warehouse.path(FCT_MEASUREMENTS)}/day={day}").select("path").collect()]
    settled = files("2024-03-01")
    fresh = dense(spark, ["a"], 96, [("a", 30, 9), ("a", 80, 8)]).where(F.col("processed_at") >= F.lit(hour(28)))
    warehouse.rewrite(FCT_MEASUREMENTS, fresh, hour(28), hour(95))
    rows = warehouse.read(FCT_MEASUREMENTS)
    assert rows.count() == rows.select("processed_at").distinct().count() == 96
    assert {(r.processed_at, r.counted_cars) for r in rows.where("NOT is_missing").collect()} == {(hour(20), 1), (hour(30), 9), (hour(80), 8)}
    assert files("2024-03-01") == settled


def test_a_merge_is_published_without_reading_it_and_again_after_a_crash(spark, folder, monkeypatch):
    table = Table("t", "x long, a string, b string", ("a", "b"))
    warehouse = Warehouse(spark, folder)
    rows = lambda *r: spark.createDataFrame(list(r), "x long, a string, b string")
    warehouse.replace(table, rows((1, "p", "q"), (2, "p", "r"), (3, "s", None)))
    moved, rename = [], warehouse._files.rename

    def failing(source, target):
        if moved:
            raise OSError("lost")
        moved.append(target)
        rename(source, target)

    monkeypatch.setattr(warehouse._files, "rename", failing)
    try:
        warehouse.replace_partitions(table, rows((4, "p", "q"), (5, "s", None)))
        raise AssertionError("the move was not interrupted")
    except OSError:
        pass
    again = Warehouse(spark, folder)
    again.recover(table)
    again.recover(table)
    assert sorted(tuple(r) for r in again.read(table).collect()) == [(2, "p", "r"), (4, "p", "q"), (5, "s", None)]


def test_predictions_of_one_road_come_from_many_tasks(spark):
    pairs = spark.createDataFrame([("R", f"d{i}") for i in range(400)] + [("S", None)], "road_name string, device_id string")
    asked = spark.createDataFrame([("R", START.date(), h) for h in range(24)] * 2 + [("R", None, 3), ("S", START.date(), 12), ("T", START.date(), 1), ("R", START.date(), 24)], "road_name string, target_date date, target_hour int")
    scored = scoring.device_predictions(asked, pairs, lambda rows: rows.withColumn("prediction", F.lit(1.005)))
    sizes = [r["count"] for r in scored.where("road_name = 'R'").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 25 * 400 and len(sizes) == 4 and max(sizes) <= 2 * sum(sizes) / 4
    answers = scoring.device_answers(scored).distinct().collect()
    assert len(answers) == 25 * 400 + 1
    day = f"{START:%Y-%m-%d}"
    assert {r.target_datetime for r in answers} == {f"{day} {h:02d}:00" for h in range(24)} | {"null 03:00"}


def test_a_month_of_many_rows_becomes_several_sorted_files(spark, folder, monkeypatch):
    monkeypatch.setattr(lake, "TARGET_FILE_ROWS", 300)
    rows = spark.range(1000).select(
        F.concat(F.lit("d"), F.col("id") % 50).alias("deviceid"), F.lit("2024-03-01 00:00:00").alias("appprocesstime"), (F.col("id") % 9).alias("countedcars"),
        F.lit(50.0).alias("average_speed"), F.lit("R").alias("road_name"), F.lit("i").alias("road_info"), F.lit(START).cast("timestamp_ntz").alias("ingested_at"), F.lit(START.date()).alias("date"),
    )
    lake.write_batches(rows, folder)
    made = lake.compact_month(spark, folder, 2024, 3)
    assert made.rows == 1000 and 2 <= made.files_after <= 4
    assert lake.compact_month(spark, folder, 2024, 3).rows is None
    files = lake.read_lake(spark, folder).groupBy(F.input_file_name()).agg(F.min("deviceid").alias("a"), F.max("deviceid").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("a").collect()
    assert sum(f.n for f in files) == 1000 and all(f.b <= g.a for f, g in zip(files, files[1:])) and max(f.n for f in files) < 500
