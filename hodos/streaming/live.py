"""The daily job as streams over landed files."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hodos.functions.measures import speed_volume
from hodos.operators.gapfill import expand
from hodos.plans import facts, reporting, roads, staging
from hodos.plans.build import refresh_facts, refresh_gold
from hodos.schemas import LAKE, STAGING
from hodos.session import cut
from hodos.sources.tables import DIM_ROADS, STG_TRAFFIC, Table, Warehouse


def lake_stream(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LAKE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(root)


#: Daily totals that a stream keeps, one row a day.
DAILY_TOTALS = Table("daily_totals")


def _absorb(warehouse: Warehouse, batch: DataFrame) -> DataFrame:
    """Upsert one micro-batch. Running it again gives the same tables, so a batch that is
    retried after a failure does no harm.

    Files may arrive in any order: both merges compare ingestion times instead of trusting
    that the newer batch holds the newer rows.
    """
    staged = cut(staging.stage(batch))
    warehouse.upsert(STG_TRAFFIC, staged, staging.KEY, staging.staging_order())
    warehouse.upsert(DIM_ROADS, cut(roads.latest_roads(staged)), roads.KEY, roads.road_order())
    return staged


def _absorb_daily(warehouse: Warehouse, batch: DataFrame) -> None:
    """Upsert one micro-batch, then count the days it touched anew from the merged readings, so
    corrections replace what they correct and the newest day is there from its first reading."""
    staged = _absorb(warehouse, batch)
    touched = sorted(str(r.processed_date) for r in staged.select("processed_date").distinct().collect() if r.processed_date)
    if touched:
        totals = reporting.daily_speed_count(warehouse.read(STG_TRAFFIC, days=touched))
        warehouse.upsert(DAILY_TOTALS, cut(totals), ["processed_date"])


def stream_daily(warehouse: Warehouse, source: DataFrame, checkpoint: str) -> StreamingQuery:
    """Keep staging, the dimension and the totals of every day current; then stop."""
    return (
        source.writeStream.foreachBatch(lambda batch, _: _absorb_daily(warehouse, batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_staging(warehouse: Warehouse, source: DataFrame, checkpoint: str) -> StreamingQuery:
    """Keep staging and the dimension current; processes what has landed, then stops.

    Nothing is dropped by a watermark here: every landed reading reaches staging, and late
    ones are told apart when the fact is built.
    """
    return (
        source.writeStream.foreachBatch(lambda batch, _: _absorb(warehouse, batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_warehouse(warehouse: Warehouse, source: DataFrame, checkpoint: str, as_of: datetime, **facts) -> None:
    """Drain the stream, then bring facts and gold up to ``as_of``."""
    stream_staging(warehouse, source, checkpoint).awaitTermination()
    refresh_facts(warehouse, as_of, **facts)
    refresh_gold(warehouse)


def deduplicated(source: DataFrame, delay: str = "2 days") -> DataFrame:
    """Stateful form of staging: the first delivery per device and hour.

    State is bounded by the watermark. Event time has to be a zoned timestamp in a stream;
    the session zone is UTC, so the cast keeps the value.
    """
    typed = staging.typed(source).withColumn("event_time", F.col("processed_at").cast("timestamp"))
    return typed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["device_id", "processed_at"])


def daily_totals(readings: DataFrame, delay: str | None = None) -> DataFrame:
    """Cars and weighted speed per day as a tumbling window over event time."""
    timed = readings if delay is None else readings.withWatermark("event_time", delay)
    return (
        timed.groupBy(F.window("event_time", "1 day"))
        .agg(
            F.sum("counted_cars").alias("total_counted_cars"),
            (F.sum(speed_volume()) / F.nullif(F.sum("counted_cars"), F.lit(0))).alias("weighted_avg_speed"),
        )
        .select(
            F.col("window.start").cast("timestamp_ntz").cast("date").alias("processed_date"),
            "total_counted_cars",
            "weighted_avg_speed",
        )
    )


# --- stateful forms that agree with the batch, once the watermark is past an hour -----------


def hourly_readings(source: DataFrame, delay: str = "2 days") -> DataFrame:
    """Staging as a stream: of the deliveries of a reading the one the batch takes, given out when
    the watermark has passed its hour (``window``). State holds the hours still open."""
    typed = staging.typed(source).withColumn("event_time", F.col("processed_at").cast("timestamp"))
    newest_first = [F.col("ingested_at").isNull(), -F.unix_micros(F.col("ingested_at").cast("timestamp"))]
    rest = [part for name in ("counted_cars", "average_speed", "road_name", "road_info", "traffic_id") for part in (F.col(name).isNull(), F.col(name))]
    order = F.struct(*[part.alias(f"o{i}") for i, part in enumerate(newest_first + rest)])
    row = F.struct(*[F.col(name) for name in STAGING.fieldNames()])
    kept = typed.withWatermark("event_time", delay).groupBy(F.window("event_time", "1 hour"), "device_id", "processed_at").agg(F.min_by(row, order).alias("row"))
    return kept.select("window", "row.*")


def closed_days(source: DataFrame, delay: str = "2 days") -> DataFrame:
    """Cars and weighted speed of every day the watermark has passed, each given out once: a
    tumbling window of a day over the tumbling windows of its hours."""
    days = hourly_readings(source, delay).groupBy(F.window("window", "1 day")).agg(
        F.sum("counted_cars").alias("total_counted_cars"),
        (F.sum(speed_volume()) / F.nullif(F.sum("counted_cars"), F.lit(0))).alias("weighted_avg_speed"),
    )
    return days.select(F.col("window.start").cast("timestamp_ntz").cast("date").alias("processed_date"), "total_counted_cars", "weighted_avg_speed")


#: Parts of the devices that share a state; what a batch brings a part is in one task's memory.
PARTS = 512
#: In ``nulls``: which measures of a reading are null and whether its speed is no number; GAP: no reading.
NO_TIME, NO_CARS, NO_SPEED, NAN_SPEED, GAP = 1, 2, 4, 8, -1
MEASURED = ("hour", "ingested", "cars", "speed", "nulls")
#: A device's number times APART, plus an hour, is a place on one line for all devices; hours count from 1970.
APART, HOUR_MS = 1 << 32, 3_600_000


def _chosen(at, ingested, cars, speed, nulls) -> list[np.ndarray]:
    """Of the deliveries at a place the one the batch takes (``staging.staging_order``; the columns
    behind the speed do not show in what is chosen), by place."""
    order = np.lexsort((speed, nulls & NAN_SPEED, nulls & NO_SPEED, cars, nulls & NO_CARS, -ingested, nulls & NO_TIME, at))
    order = order[np.append(True, np.diff(at[order]) > 0)[: len(order)]]
    return [values[order] for values in (at, ingested, cars, speed, nulls)]


def _joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches in order; those that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    apart = np.flatnonzero(starts[1:] > ends[:-1] + 1)
    return (starts[np.append(0, apart + 1)], ends[np.append(apart, len(ends) - 1)]) if len(starts) else (starts, ends)


def _close_hours(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One part of the devices: its state is the stretches of hours that are open and their readings;
    hours the watermark closed are given out as readings and the gaps between them."""
    watermark = max(0, state.getCurrentWatermarkMs())
    closed = watermark // HOUR_MS
    known, kept = state.get if state.exists else ((), bytes(8))
    frames = [frame for frame in frames if len(frame)]  # a timeout comes with an empty one
    codes, names = pd.factorize(np.concatenate([np.array(known, object), *(frame["device_id"].to_numpy(object) for frame in frames)]), use_na_sentinel=False)
    names = np.array([None if name is None or name != name else name for name in names], object)

    kept, read = np.frombuffer(kept, "int64"), len(known)
    n = int(kept[0])
    starts, ends, columns = [kept[1 : 1 + n]], [kept[1 + n : 1 + 2 * n]], [[c] for c in kept[1 + 2 * n :].reshape(len(MEASURED), -1)]
    columns[3] = [columns[3][0].view("float64")]
    for frame in frames:
        at = codes[read : read + len(frame)] * APART + frame["hour"].to_numpy()
        is_slot, read = frame["nulls"].to_numpy() == GAP, read + len(frame)
        starts.append(at[is_slot]), ends.append(at[is_slot])
        for held, values in zip(columns, (at, *(frame[name].to_numpy() for name in MEASURED[1:]))):
            held.append(values[~is_slot])
    starts, ends = _joined(np.concatenate(starts), np.concatenate(ends))
    at, *measures = _chosen(*map(np.concatenate, columns))

    line = starts - starts % APART  # where the device begins
    left, ahead = ends >= line + closed, at % APART >= closed
    if left.any() or ahead.any():
        still = np.maximum(starts, line + closed)[left]
        devices = np.unique(np.append(still, at[ahead]) // APART)
        again = lambda places: np.searchsorted(devices, places // APART) * APART + places % APART
        rest = [again(still), again(ends[left]), again(at[ahead]), *(values[ahead].view("int64") for values in measures)]
        state.update((names[devices].tolist(), np.concatenate([[len(still)], *rest]).astype("int64").tobytes()))
        # A timeout fires when the watermark is past it.
        first_open = int((np.append(still, at[ahead]) % APART).min())
        state.setTimeoutTimestamp(max((first_open + 1) * HOUR_MS - 1, watermark + 1))
    elif state.exists:
        state.remove()

    gone = starts < line + closed
    starts, ends = starts[gone], np.minimum(ends, line + closed - 1)[gone]
    if not len(starts):
        return
    stretch = np.searchsorted(starts, at, "right") - 1
    found = (stretch >= 0) & (at <= ends[stretch])
    at, measures = at[found], [values[found] for values in measures]
    # What a stretch leaves around its readings: starts and ends pair up in order.
    first, last = np.sort(np.append(starts, at + 1)), np.sort(np.append(ends, at - 1))
    gap = first <= last
    n = int(gap.sum())
    blanks = [np.append(values, np.full(n, fill, values.dtype)) for values, fill in zip(measures, (0, 0, 0, GAP))]
    first, last = np.append(at, first[gap]), np.append(at, last[gap])
    places = (pd.Series(names[first // APART], dtype=object), first % APART, last % APART)
    yield pd.DataFrame(dict(zip(("device_id", "first", "last", *MEASURED[1:]), (*places, *blanks))))


def filled_hours(spine: DataFrame, source: DataFrame, delay: str = "2 days") -> DataFrame:
    """The dense fact as a stream: hours of ``spine`` (device_id, processed_at) with the reading
    of that hour or, when the watermark has passed it on both sides, without one.

    Both sides meet at their device. The state holds stretches of its open hours and the readings
    in them, not a row for every hour; what the watermark has passed leaves as spans, which become
    hours behind the state. Readings that are not on the hour or have no device meet no slot.
    """
    start = F.col("window.start")
    # As in a window of an hour, a row is late when the watermark has passed the end of its hour.
    place = [F.window_time("window").alias("until"), F.floor(F.unix_seconds(start) / 3600).alias("hour")]
    none = [F.lit(0).cast(kind).alias(name) for name, kind in zip(MEASURED[1:], ("long", "long", "double"))]
    timed = lambda rows: rows.withColumn("event_time", F.col("processed_at").cast("timestamp")).withWatermark("event_time", delay).withColumn("window", F.window("event_time", "1 hour"))
    slots = timed(spine).select("device_id", *place, *none, F.lit(GAP).cast("long").alias("nulls"))

    speed, ingested = F.col("average_speed"), F.col("ingested_at")
    flags = {NO_TIME: ingested.isNull(), NO_CARS: F.col("counted_cars").isNull(), NO_SPEED: speed.isNull(), NAN_SPEED: speed.isNotNull() & F.isnan(speed)}
    readings = timed(staging.typed(source)).where((F.col("event_time") == start) & F.col("device_id").isNotNull()).select(
        "device_id",
        *place,
        F.coalesce(F.unix_micros(ingested.cast("timestamp")), F.lit(0)).cast("long").alias("ingested"),
        F.coalesce("counted_cars", F.lit(0)).cast("long").alias("cars"),
        F.when(flags[NO_SPEED] | flags[NAN_SPEED], 0.0).otherwise(speed).alias("speed"),
        reduce(add, [F.when(is_so, bit).otherwise(0) for bit, is_so in flags.items()]).cast("long").alias("nulls"),
    )
    given_out = "device_id string, first long, last long, ingested long, cars long, speed double, nulls long"
    met = readings.unionByName(slots).withColumn("part", F.pmod(F.xxhash64("device_id"), F.lit(PARTS)).cast("int"))
    closed = met.groupBy("part").applyInPandasWithState(_close_hours, given_out, "devices array<string>, open binary", "append", GroupStateTimeout.EventTimeTimeout)
    has = lambda bit: F.col("nulls").bitwiseAND(F.lit(bit)) == 0
    at = lambda name: F.timestamp_seconds(F.col(name) * 3600).cast("timestamp_ntz")
    spans = closed.select(
        "device_id",
        at("first").alias("first_hour"),
        at("last").alias("last_hour"),
        F.when(has(NO_TIME), F.timestamp_micros("ingested").cast("timestamp_ntz")).alias("ingested_at"),
        F.when(has(NO_CARS), F.col("cars")).alias("counted_cars"),
        F.when(has(NO_SPEED), F.when(has(NAN_SPEED), F.col("speed")).otherwise(F.lit(float("nan")))).alias("average_speed"),
    )
    return facts.described(expand(spans))
