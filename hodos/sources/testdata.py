"""The given tables in the shape of sensor data.

``events`` becomes a month of hourly raw records with duplicates and every kind of bad
reading; ``lineitem`` joined with ``supplier`` becomes a gold table of several years.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hodos.functions.calendar import calendar_columns, days, full_day, full_hour, hours
from hodos.functions.measures import quality_flags
from hodos.plans.roads import ROAD_ALIASES
from hodos.schemas import MART_COLUMNS, RAW

# Road names of the adapter: every known spelling, and five names that need no change,
# some of them equal to what a spelling is changed to.
ROAD_NAMES = (*ROAD_ALIASES, "ΚΗΦΙΣΙΑΣ", "ΜΕΣΟΓΕΙΩΝ", "ΠΕΙΡΑΙΩΣ", "ΙΕΡΑ ΟΔΟΣ", "ΑΘΗΝΩΝ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def road_of(user: Column) -> Column:
    names = F.array(*[F.lit(name) for name in ROAD_NAMES])
    return F.element_at(names, (user % len(ROAD_NAMES) + 1).cast("int"))


def raw_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records, ingested at 05:00 on the day after the reading."""
    events = table(spark, sf_dir, "events")
    at = full_hour(F.col("ts"))
    columns = {
        "deviceid": F.col("user_id").cast("string"),
        "appprocesstime": at.cast("string"),
        "countedcars": F.get_json_object("props", "$.k").cast("bigint"),
        "average_speed": F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")),
        "road_name": road_of(F.col("user_id")),
        "road_info": F.concat(F.lit("seg-"), (F.col("event_id") % 7).cast("string")),
        "ingested_at": full_day(F.col("ts")) + hours(29),
    }
    return events.select(
        *[columns[f.name].alias(f.name) for f in RAW.fields],
        F.year("ts").alias("year"),
        F.month("ts").alias("month"),
    )


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records plus corrections: failed readings are sent again three days later."""
    events = table(spark, sf_dir, "events")
    first = raw_traffic(spark, sf_dir)
    corrected = events.where("event_type = 'error'").select(
        F.col("user_id").cast("string").alias("deviceid"),
        full_hour(F.col("ts")).cast("string").alias("appprocesstime"),
        F.get_json_object("props", "$.k").cast("bigint").alias("countedcars"),
        F.col("value").alias("average_speed"),
        road_of(F.col("user_id")).alias("road_name"),
        F.lit("corrected").alias("road_info"),
        (full_day(F.col("ts")) + hours(29) + days(3)).alias("ingested_at"),
        F.year("ts").alias("year"),
        F.month("ts").alias("month"),
    )
    return first.unionByName(corrected)


def respelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The redelivered records, corrections with another spelling of their time."""
    iso = F.concat(F.translate("appprocesstime", " ", "T"), F.lit("Z"))
    return redelivered(spark, sf_dir).withColumn("appprocesstime", F.when(F.col("road_info") == "corrected", iso).otherwise(F.col("appprocesstime")))


def spoilt_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as JSON lines of the feed, some of them cut short or with values that do not fit."""
    events = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 50
    fields = {
        "deviceid": F.when(kind != 29, F.col("user_id").cast("string")),
        "appprocesstime": F.when(kind == 19, F.lit("not a time")).otherwise(full_hour(F.col("ts")).cast("string")),
        "countedcars": F.when(kind.isin(13, 19), F.lit("many")).otherwise(F.get_json_object("props", "$.k")),
        "average_speed": F.col("value").cast("string"),
        "road_name": road_of(F.col("user_id")),
    }
    line = F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))
    return events.select(F.when(kind == 7, F.substring(line, 1, 20)).otherwise(line).alias("value"))


def hour_range(spark: SparkSession, sf_dir: str) -> tuple[datetime, datetime]:
    """First and last hour with events: the run's clock, one row of two values."""
    at = F.col("ts")
    row = table(spark, sf_dir, "events").agg(full_hour(F.min(at)), full_hour(F.max(at))).first()
    return row[0], row[1]


def long_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows from 1995 to 2001, those of quality: a supplier is a device, its nation a road."""
    lines, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    at = F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber"))
    speed = (F.col("l_partkey") % 140).cast("double")
    rows = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select(
        F.col("l_suppkey").cast("string").alias("device_id"),
        at.alias("processed_at"),
        F.col("l_quantity").cast("bigint").alias("counted_cars"),
        speed.alias("average_speed"),
        F.col("s_nationkey").cast("string").alias("road_name"),
    )
    described = rows.select(
        "*", *calendar_columns(F.col("processed_at")), (F.col("processed_at") + days(1)).alias("ingested_at")
    )
    return described.where(quality_flags()["is_quality"]).select(*MART_COLUMNS)
