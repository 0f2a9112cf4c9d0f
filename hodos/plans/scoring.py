"""Road speed predictions for any number of requests in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from hodos.session import shuffle_tasks

REQUEST = ("road_name", "target_date", "target_hour")
#: Parts a road's devices are dealt into; a question meets each part in a group of its own.
PARTS = 64


def rejected(requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Requests that cannot be answered, with the reason."""
    in_range = F.coalesce(F.col("target_hour").between(0, 23), F.lit(False))
    bad_hour = requests.where(~in_range).withColumn("reason", F.lit("target_hour outside 0..23"))
    roads = pairs.select("road_name").distinct()
    unknown = requests.where(in_range).join(roads, "road_name", "left_anti")
    reason = F.format_string("no device is known on road '%s'", F.coalesce("road_name", F.lit("")))
    return bad_hour.unionByName(unknown.withColumn("reason", reason))


def device_predictions(requests: DataFrame, pairs: DataFrame, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One prediction per distinct (road, date, hour) and device on that road.

    Requests are reduced to distinct questions first: however many people ask for the same
    road and hour, each device is scored once. A few roads hold all of the devices and few bytes
    make many predictions: devices are dealt into parts of their road, over a fixed number of
    tasks that AQE does not merge by size.
    """
    questions = requests.where(F.col("target_hour").between(0, 23)).select(*REQUEST).distinct()
    tasks, keys = shuffle_tasks(requests.sparkSession), ["road_name", "_part"]
    dealt = pairs.withColumn("_part", F.pmod(F.xxhash64("device_id"), F.lit(PARTS)).cast("int")).repartition(tasks, *keys)
    asked = questions.join(dealt.select(*keys).distinct(), "road_name").repartition(tasks, *keys)
    base = asked.join(dealt, keys).select(
        "device_id", "road_name", F.col("target_date").alias("date"), F.col("target_hour").cast("bigint").alias("hour")
    )
    return predict(base)


def _clock(day: str, hour: str) -> Column:
    # As format_string("%s %02d:00") has it, which costs more than the rest of a row.
    number = F.col(hour).cast("string")
    digits = F.when(F.col(hour).between(0, 9), F.concat(F.lit("0"), number)).otherwise(number)
    return F.concat(F.coalesce(F.col(day).cast("string"), F.lit("null")), F.lit(" "), F.coalesce(digits, F.lit("null")), F.lit(":00"))


def device_answers(predictions: DataFrame) -> DataFrame:
    """One row per road, moment and device with its rounded prediction; nothing is gathered."""
    return predictions.select("road_name", _clock("date", "hour").alias("target_datetime"), "device_id", F.bround("prediction", 2).alias("speed"))


def road_answers(predictions: DataFrame) -> DataFrame:
    """Mean over a road's devices, their number, and each device's rounded prediction.

    The breakdown is as long as the road has sensors. Keep to ``device_answers`` where one
    row per device is wanted.
    """
    breakdown = F.map_from_entries(
        F.sort_array(F.collect_list(F.struct("device_id", F.bround("prediction", 2).alias("speed"))))
    )
    return (
        predictions.groupBy("road_name", F.col("date").alias("target_date"), F.col("hour").alias("target_hour"))
        .agg(
            F.bround(F.avg("prediction"), 2).alias("average_predicted_speed_kmh"),
            F.count(F.lit(1)).alias("active_devices_used"),
            breakdown.alias("device_breakdown"),
        )
        .withColumn("target_datetime", _clock("target_date", "target_hour"))
    )


def score_roads(requests: DataFrame, pairs: DataFrame, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answer every valid request (see :func:`rejected` for the others)."""
    answers = road_answers(device_predictions(requests, pairs, predict))
    return requests.join(answers, list(REQUEST))
