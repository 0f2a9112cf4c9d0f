"""Streams over landed files agree with the batch jobs."""

from datetime import datetime, timedelta

from compare import SF_DIR
from pyspark.sql import functions as F

from hodos.plans import build, roads, staging
from hodos.schemas import LAKE
from hodos.sources import lake, testdata
from hodos.sources.tables import DIM_ROADS, FCT_MEASUREMENTS, STG_TRAFFIC, Warehouse
from hodos.streaming import live


def rows(df):
    return sorted(map(str, df.collect()))


def as_lake(spark, root):
    """One batch per ingestion day, with corrections of earlier readings among them."""
    raw = testdata.redelivered(spark, SF_DIR).drop("year", "month")
    lake.write_batches(raw.withColumn("date", F.col("ingested_at").cast("date")), root)


def test_stream_equals_batch_in_any_file_order(spark, folder):
    root = f"{folder}/lake"
    as_lake(spark, root)
    warehouse = Warehouse(spark, folder)
    live.stream_staging(warehouse, live.lake_stream(spark, root, files_per_batch=15), f"{folder}/offsets").awaitTermination()
    want = staging.stage(lake.read_lake(spark, root))
    assert rows(warehouse.read(STG_TRAFFIC).select(*want.columns)) == rows(want)
    assert rows(warehouse.read(DIM_ROADS)) == rows(roads.latest_roads(want))


def test_a_drained_stream_takes_up_new_files(spark, folder):
    def drop(day, device):
        row = [(device, f"2024-01-0{day} 03:00:00", 5, 50.0, "R", "i", datetime(2024, 1, day + 1, 5))]
        df = spark.createDataFrame(row, "deviceid string, appprocesstime string, countedcars long, average_speed double, road_name string, road_info string, ingested_at timestamp_ntz")
        lake.write_batches(df.withColumn("date", F.to_date("appprocesstime")), f"{folder}/lake")

    warehouse = Warehouse(spark, folder)
    run = lambda now: live.stream_warehouse(
        warehouse, live.lake_stream(spark, f"{folder}/lake"), f"{folder}/offsets", now,
        full=False, lookback_days=2, anchor="spine", spine_start=datetime(2024, 1, 1))
    drop(1, "a")
    run(datetime(2024, 1, 2, 5))
    drop(2, "b")
    run(datetime(2024, 1, 3, 5))
    assert warehouse.read(STG_TRAFFIC).count() == 2
    found = {(r.device_id, r.processed_at) for r in warehouse.read(FCT_MEASUREMENTS).where("NOT is_missing").collect()}
    assert found == {("a", datetime(2024, 1, 1, 3)), ("b", datetime(2024, 1, 2, 3))}
    assert build.homepage_tables(warehouse)["last_kpi"].first().sum_counted_cars == 10


def test_stateful_deduplication_and_daily_window(spark, folder):
    root = f"{folder}/lake"
    as_lake(spark, root)
    source = spark.readStream.schema(LAKE).parquet(root)
    unique = live.deduplicated(source)
    query = (
        unique.select("device_id", "processed_at").writeStream.format("parquet").option("path", f"{folder}/keys")
        .option("checkpointLocation", f"{folder}/c1").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    want = staging.stage(lake.read_lake(spark, root)).select("device_id", "processed_at")
    assert rows(spark.read.parquet(f"{folder}/keys")) == rows(want)

    totals = live.daily_totals(live.deduplicated(source).select("event_time", "counted_cars", "average_speed"))
    query = (
        totals.writeStream.format("parquet").option("path", f"{folder}/days").outputMode("append")
        .option("checkpointLocation", f"{folder}/c2").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    closed = sorted(r.processed_date for r in spark.read.parquet(f"{folder}/days").collect())
    # A day is complete once the watermark, two days behind the newest reading, is past its end.
    newest = want.agg(F.max("processed_at")).first()[0]
    days = sorted({r.processed_at.date() for r in want.collect()})
    passed = [d for d in days if datetime(d.year, d.month, d.day) + timedelta(days=1) <= newest - timedelta(days=2)]
    assert closed == passed and len(passed) == 27
