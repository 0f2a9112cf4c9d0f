"""Landing, batches, backfill and compaction."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from hodos.schemas import LANDING
from hodos.sources import lake
from hodos.sources.files import Files

CLOCK = datetime(2024, 3, 1, 5)


def records(spark, days, per_day=3):
    rows = [
        (f"MS{i}", f"{day}T{i:02d}:00:00Z", 10 + i, 50.0 + i, "ΚΗΦΙΣΙΑΣ", "info", day)
        for day in days
        for i in range(per_day)
    ]
    return spark.createDataFrame(rows, "deviceid string, appprocesstime string, countedcars long, average_speed double, road_name string, road_info string, date string")


def land(spark, folder, days, **kw):
    records(spark, days, **kw).write.mode("append").partitionBy("date").json(f"{folder}/landing")
    return f"{folder}/landing"


def content(df):
    return sorted(map(str, df.select("deviceid", "appprocesstime", "countedcars", "ingested_at").collect()))


def test_landing_schema_and_stamp(spark, folder):
    landed = lake.read_landing(spark, land(spark, folder, ["2024-02-23"]))
    assert [f.name for f in landed.schema] == [*LANDING.names, "date"]
    assert {r.ingested_at for r in lake.stamp(landed, CLOCK).collect()} == {CLOCK}


def test_landing_reads_a_json_array_per_file(spark, folder):
    array = '[{"deviceid": "MS1", "countedcars": 5},\n {"deviceid": "MS2", "countedcars": 6}]'
    path = f"{folder}/landing/date=2024-02-23"
    spark.createDataFrame([(array,)], "value string").coalesce(1).write.text(path)
    landed = lake.read_landing(spark, f"{folder}/landing", multiline=True)
    assert sorted(r.countedcars for r in landed.collect()) == [5, 6]


def test_malformed_records_stop_the_job(spark, folder):
    spark.createDataFrame([('{"deviceid": ',)], "value string").write.text(f"{folder}/landing/date=2024-02-23")
    with pytest.raises(Exception, match="(?i)malformed"):
        lake.read_landing(spark, f"{folder}/landing").collect()


def test_daily_batch_lands_in_its_partition_and_replaces_itself(spark, folder):
    landing, root = land(spark, folder, ["2024-02-22", "2024-02-23"]), f"{folder}/lake"
    for day in (date(2024, 2, 22), date(2024, 2, 23), date(2024, 2, 23)):
        lake.ingest_day(spark, landing, root, day, CLOCK)
    assert Files(spark).folders(f"{root}/year=2024/month=02") == ["batch=2024-02-22", "batch=2024-02-23"]
    assert lake.read_lake(spark, root).count() == 6
    assert {(r.year, r.month) for r in lake.read_lake(spark, root).collect()} == {(2024, 2)}


def test_a_day_without_records_is_an_error(spark, folder):
    landing = land(spark, folder, ["2024-02-22"])
    with pytest.raises(lake.DataMissingError):
        lake.ingest_day(spark, landing, f"{folder}/lake", date(2024, 2, 23), CLOCK)


def test_one_year_is_a_partition_filter(spark, folder):
    lake.write_batches(lake.stamp(records(spark, ["2024-02-23", "2025-01-02"]).withColumn("date", F.to_date("date")), CLOCK), folder)
    one = lake.read_lake(spark, folder, year=2025)
    assert one.count() == 3
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_missing_days(spark, folder):
    landed = lake.read_landing(spark, land(spark, folder, ["2024-02-22", "2024-02-25"]))
    gaps = lake.missing_days(landed.select(F.col("date").alias("day")), date(2024, 2, 22), date(2024, 2, 26))
    assert sorted(r.day for r in gaps.collect()) == [date(2024, 2, 23), date(2024, 2, 24), date(2024, 2, 26)]


def test_backfill_skips_missing_days_and_compacts_by_month(spark, folder):
    landing = land(spark, folder, ["2024-01-30", "2024-02-01", "2024-02-03", "2024-02-09"])
    root = f"{folder}/lake"
    done = lake.backfill(spark, landing, root, date(2024, 1, 30), date(2024, 2, 3), CLOCK)
    assert sorted(r.day.day for r in done.missing.collect()) == [2, 31]
    assert [(c.year, c.month, c.rows) for c in done.compactions] == [(2024, 1, 3), (2024, 2, 6)]
    assert Files(spark).folders(f"{root}/year=2024/month=02") == ["batch=compact-2024-02"]
    with pytest.raises(lake.DataMissingError):
        lake.backfill(spark, landing, root, date(2024, 1, 30), date(2024, 2, 3), CLOCK, strict=True)


def test_backfill_of_part_of_a_month_keeps_the_rest(spark, folder):
    landing, root = land(spark, folder, ["2024-02-01", "2024-02-02", "2024-02-20"]), f"{folder}/lake"
    lake.backfill(spark, landing, root, date(2024, 2, 20), date(2024, 2, 20), CLOCK)
    lake.backfill(spark, landing, root, date(2024, 2, 1), date(2024, 2, 2), CLOCK)
    assert lake.read_lake(spark, root).count() == 9


def test_compaction_keeps_every_row_in_one_sorted_file(spark, folder):
    days = ["2024-02-01", "2024-02-02", "2024-02-03"]
    for i, day in enumerate(days):
        batch = records(spark, [day]).withColumn("date", F.to_date("date"))
        lake.write_batches(lake.stamp(batch, datetime(2024, 2, 10 - i)), folder)
    before = content(lake.read_lake(spark, folder))
    report = lake.compact_month(spark, folder, 2024, 2)
    assert (report.files_before, report.files_after, report.rows) == (3, 1, 9)
    assert Files(spark).folders(f"{folder}/year=2024/month=02") == ["batch=compact-2024-02"]
    after = lake.read_lake(spark, folder)
    assert content(after) == before
    stamps = [r.ingested_at for r in after.collect()]
    assert stamps == sorted(stamps)
    assert lake.compact_month(spark, folder, 2024, 2).rows is None  # nothing left to do


def test_compaction_cuts_a_large_month_into_several_files(spark, folder):
    lake.write_batches(lake.stamp(records(spark, ["2024-02-01", "2024-02-02"], per_day=20).withColumn("date", F.to_date("date")), CLOCK), folder)
    report = lake.compact_month(spark, folder, 2024, 2, target_file_bytes=2000)
    assert report.files_after > 1 and report.rows == 40


def test_interrupted_compaction_is_completed(spark, folder, monkeypatch):
    lake.write_batches(lake.stamp(records(spark, ["2024-02-01", "2024-02-02"]).withColumn("date", F.to_date("date")), CLOCK), folder)
    before = content(lake.read_lake(spark, folder))

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(lake, "_finish", crash)
        with pytest.raises(RuntimeError):
            lake.compact_month(spark, folder, 2024, 2)
    assert content(lake.read_lake(spark, folder)) == before  # originals untouched
    lake.compact_month(spark, folder, 2024, 2)
    assert content(lake.read_lake(spark, folder)) == before
    assert Files(spark).folders(f"{folder}/year=2024/month=02") == ["batch=compact-2024-02"]


def test_a_batch_after_compaction_joins_the_next_one(spark, folder):
    write = lambda day: lake.write_batches(lake.stamp(records(spark, [day]).withColumn("date", F.to_date("date")), CLOCK), folder)
    write("2024-02-01"), write("2024-02-02")
    lake.compact_month(spark, folder, 2024, 2)
    write("2024-02-03")
    assert lake.compact_month(spark, folder, 2024, 2).rows == 9
    assert Files(spark).folders(f"{folder}/year=2024/month=02") == ["batch=compact-2024-02-r2"]


def test_a_backfill_twice_and_a_day_landed_again_leave_one_copy(spark, folder):
    landing, root = land(spark, folder, ["2024-01-31", "2024-02-01", "2024-02-02", "2024-02-03"]), f"{folder}/lake"
    for _ in range(2):
        lake.backfill(spark, landing, root, date(2024, 1, 31), date(2024, 2, 3), CLOCK)
        assert lake.read_lake(spark, root).count() == 12
    later = datetime(2024, 3, 2, 5)
    lake.ingest_day(spark, landing, root, date(2024, 2, 2), later)
    again = lake.read_lake(spark, root)
    assert again.count() == 12 and again.where(F.col("ingested_at") == later).count() == 3
    assert {r.batch for r in again.collect()} == {"compact-2024-01", "compact-2024-02"}


def test_an_interrupted_second_landing_is_settled_by_the_next_write(spark, folder, monkeypatch):
    landing, root = land(spark, folder, ["2024-02-01", "2024-02-02"]), f"{folder}/lake"
    lake.backfill(spark, landing, root, date(2024, 2, 1), date(2024, 2, 2), CLOCK)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(lake, "settle", crash)
        with pytest.raises(RuntimeError):
            lake.ingest_day(spark, landing, root, date(2024, 2, 2), CLOCK)
    lake.ingest_day(spark, landing, root, date(2024, 2, 2), CLOCK)
    assert lake.read_lake(spark, root).count() == 6
