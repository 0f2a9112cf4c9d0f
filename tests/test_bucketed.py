"""Tables bucketed by device: no exchange behind the write, rows unchanged."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hodos.plans import facts, marts, roads
from hodos.sources import bucketed

FIRST = datetime(2024, 2, 1)
LAST = FIRST + timedelta(hours=30)


def staged(spark, *rows):
    """Rows of (device, hour, cars, road)."""
    data = [(d, FIRST + timedelta(hours=h), cars, 50.0, road, "info", FIRST + timedelta(days=3)) for d, h, cars, road in rows]
    kinds = "device_id string, processed_at timestamp_ntz, counted_cars long, average_speed double, road_name string, road_info string, ingested_at timestamp_ntz"
    return spark.createDataFrame(data, kinds)


@pytest.fixture
def unassisted(spark):
    """Spark must not broadcast its way around an exchange."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


READINGS = [("a", 0, 5, "X"), ("a", 3, 6, "X"), ("a", 30, 7, "Y"), ("b", 7, 1, None), ("c", 1, 9, "Z"), ("c", 2, 9, "Z"), (None, 4, 2, "X"), ("d", 31, 3, "X")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_gap_fill_and_road_join_have_no_exchange(spark, folder, unassisted):
    rows = staged(spark, *READINGS)
    stored = bucketed.write(rows, f"{folder}/staged", "device_id", 3)
    dim = bucketed.write(roads.latest_roads(stored), f"{folder}/roads", "device_id", 3)
    dense = facts.measurements_in_place(stored, dim, FIRST, LAST)
    gold = marts.traffic_road(dense, dim)
    plan = plan_of(gold)
    assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 2
    plain = facts.measurements(rows, roads.latest_roads(rows), FIRST, LAST)
    assert rows_of(dense) == rows_of(plain)
    assert dense.count() == 5 * 31  # the dimension keeps a null device, whose hours are all gaps
    assert rows_of(gold) == rows_of(marts.traffic_road(plain, roads.latest_roads(rows)))
    assert "Exchange" in plan_of(marts.traffic_road(facts.measurements_in_place(rows, roads.latest_roads(rows), FIRST, LAST), dim))


def test_silent_devices_and_empty_tables(spark, folder):
    rows = staged(spark, ("a", 0, 5, "X"))
    devices = spark.createDataFrame([("a",), ("silent",)], "device_id string")
    dense = facts.measurements_in_place(rows, devices, FIRST, LAST)
    assert {(r.device_id, r["count"]) for r in dense.groupBy("device_id").count().collect()} == {("a", 31), ("silent", 31)}
    assert rows_of(dense) == rows_of(facts.measurements(rows, devices, FIRST, LAST))
    empty = bucketed.write(rows.where("false"), f"{folder}/empty", "device_id", 2)
    assert facts.measurements_in_place(empty, devices.where("false"), FIRST, LAST).count() == 0
    assert facts.measurements_in_place(empty, devices, FIRST, LAST).where("counted_cars IS NULL").count() == 62


def test_another_session_finds_the_buckets(spark, folder, unassisted):
    stored = bucketed.write(staged(spark, *READINGS), folder, "device_id", 3)
    want = rows_of(stored)
    name = stored.inputFiles()[0].split("/")[-2]
    assert name == "device_id-3"
    spark.sql(f"DROP TABLE {bucketed._name(f'{folder}/{name}')}")  # an outside folder keeps its files
    found = bucketed.read(spark, folder)
    assert rows_of(found) == want
    assert "Exchange" not in plan_of(found.groupBy("device_id").agg(F.count(F.lit(1))))


def test_an_incomplete_write_is_an_error(spark, folder):
    bucketed.write(staged(spark, *READINGS), folder, "device_id", 2)
    bucketed.Files(spark).delete(f"{folder}/device_id-2/_SUCCESS")
    with pytest.raises(FileNotFoundError):
        bucketed.read(spark, folder)
