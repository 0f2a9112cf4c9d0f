"""Explicit schemas; nothing in the lake is ever inferred from the files."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# One record as delivered by the sensor feed. The timestamp stays text here: the feed
# writes ISO strings with a zone letter, and staging owns the cast.
LANDING = _struct(
    deviceid=T.StringType(),
    appprocesstime=T.StringType(),
    countedcars=T.LongType(),
    average_speed=T.DoubleType(),
    road_name=T.StringType(),
    road_info=T.StringType(),
)

RAW = T.StructType(LANDING.fields + [T.StructField("ingested_at", T.TimestampNTZType(), True)])

# How a batch of raw records lies on disk: year=2024/month=02/batch=2024-02-23/*.parquet
LAKE_PARTITIONS = ("year", "month", "batch")
LAKE = T.StructType(
    RAW.fields
    + _struct(year=T.IntegerType(), month=T.IntegerType(), batch=T.StringType()).fields
)

STAGING = _struct(
    traffic_id=T.StringType(),
    device_id=T.StringType(),
    processed_at=T.TimestampNTZType(),
    processed_date=T.DateType(),
    ingested_at=T.TimestampNTZType(),
    counted_cars=T.LongType(),
    average_speed=T.DoubleType(),
    road_name=T.StringType(),
    road_info=T.StringType(),
    processed_year=T.ShortType(),
    processed_month=T.ShortType(),
)

ROADS = _struct(
    device_id=T.StringType(),
    road_name=T.StringType(),
    road_info=T.StringType(),
    ingested_at=T.TimestampNTZType(),
    described_at=T.TimestampNTZType(),  # the reading the road was taken from
)

FACTS = _struct(
    device_id=T.StringType(),
    processed_at=T.TimestampNTZType(),
    processed_date=T.DateType(),
    processed_day=T.StringType(),
    processed_hour=T.StringType(),
    ingested_at=T.TimestampNTZType(),
    counted_cars=T.LongType(),
    average_speed=T.DoubleType(),
    is_ghost_reading=T.BooleanType(),
    is_dead=T.BooleanType(),
    is_impossible_speed=T.BooleanType(),
    is_missing=T.BooleanType(),
    is_quality=T.BooleanType(),
    processed_year=T.IntegerType(),
    processed_month=T.IntegerType(),
)

MART_COLUMNS = (
    "device_id",
    "processed_at",
    "processed_date",
    "processed_year",
    "processed_month",
    "processed_day",
    "processed_hour",
    "ingested_at",
    "counted_cars",
    "average_speed",
    "road_name",
)
