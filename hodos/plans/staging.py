"""Silver: typed, deduplicated readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hodos.operators.dedup import keep_first
from hodos.schemas import LANDING, STAGING

#: A reading; the text of its time may be spelled differently from delivery to delivery.
KEY = ["device_id", "processed_at"]


def staging_order() -> list[Column]:
    """Which of several deliveries of one reading counts: the latest ingested.

    The remaining columns only make the choice reproducible; rows equal in all of them
    are interchangeable. The same order decides between batches, so a full rebuild and a
    series of incremental runs agree.
    """
    return [
        F.col("ingested_at").desc_nulls_last(),
        *[F.col(name).asc_nulls_last() for name in ("counted_cars", "average_speed", "road_name", "road_info", "traffic_id")],
    ]


def typed(raw: DataFrame) -> DataFrame:
    """Rename and cast. A value that does not fit its type stops the job."""
    at = F.col("appprocesstime").cast("timestamp_ntz")
    device = F.col("deviceid").cast("string")
    columns = {
        # The text as delivered, before any cast.
        "traffic_id": F.concat(device, F.lit("-"), F.col("appprocesstime").cast("string")),
        "device_id": device,
        "processed_at": at,
        "processed_date": at.cast("date"),
        "ingested_at": F.col("ingested_at"),
        "counted_cars": F.col("countedcars"),
        "average_speed": F.col("average_speed"),
        "road_name": F.col("road_name"),
        "road_info": F.col("road_info"),
        "processed_year": F.col("year"),
        "processed_month": F.col("month"),
    }
    return raw.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in STAGING.fields])


def stage(raw: DataFrame) -> DataFrame:
    return keep_first(typed(raw), KEY, staging_order())


def after(raw: DataFrame, high_water) -> DataFrame:
    """Rows ingested since the last run; a literal bound, so it is pushed into the scan."""
    return raw.where(F.col("ingested_at") > F.lit(high_water).cast("timestamp_ntz"))


# --- quarantine mode: bad records are set aside with a reason, the job goes on -------------


def read_permissive(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines with every value as text, and ``record``: a line that is no JSON record."""
    columns = [f"{name} string" for name in (*LANDING.fieldNames(), "record")]
    return spark.read.schema(", ".join(columns)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "record").json(path)


def quarantined(records: DataFrame) -> DataFrame:
    """Records typed column by column, with ``reason``: null if all of it fits, otherwise every
    fault, and the values as delivered in ``record``. A value that does not fit is null."""
    kinds = {"appprocesstime": "timestamp_ntz", "countedcars": "bigint", "average_speed": "double"}
    broken = F.col("record").isNotNull()
    fitted = {name: F.col(name).try_cast(kind) for name, kind in kinds.items()}
    faults = [F.when(broken, "malformed record")]
    faults += [F.when(~broken & F.col(name).isNull(), f"{name} is missing") for name in ("deviceid", "appprocesstime")]
    faults += [F.when(F.col(name).isNotNull() & fitted[name].isNull(), f"{name} is no {kind}") for name, kind in kinds.items()]
    reason = F.array_join(F.array_compact(F.array(*faults)), "; ")
    given = F.coalesce("record", F.to_json(F.struct(*LANDING.fieldNames())))
    return records.select(
        F.when(~broken, F.concat("deviceid", F.lit("-"), "appprocesstime")).alias("traffic_id"),
        F.col("deviceid").alias("device_id"),
        fitted["appprocesstime"].alias("processed_at"),
        fitted["countedcars"].alias("counted_cars"),
        fitted["average_speed"].alias("average_speed"),
        "road_name",
        "road_info",
        F.nullif(reason, F.lit("")).alias("reason"),
        F.when(reason != "", given).alias("record"),
    )


def write_quarantined(checked: DataFrame, path: str) -> None:
    """Good and bad rows in one pass over the feed, below ``is_good=true`` and ``is_good=false``."""
    checked.withColumn("is_good", F.col("reason").isNull()).write.partitionBy("is_good").parquet(path)


def read_quarantined(spark: SparkSession, path: str) -> DataFrame:
    columns = "traffic_id string, device_id string, processed_at timestamp_ntz, counted_cars bigint, average_speed double, road_name string, road_info string"
    return spark.read.schema(f"{columns}, reason string, record string, is_good boolean").parquet(path)
