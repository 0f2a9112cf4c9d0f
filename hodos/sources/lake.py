"""The bronze lake: landed JSON in, Hive-partitioned Parquet batches out.

Layout: ``<root>/year=2024/month=02/batch=2024-02-23/*.parquet``. A batch is replaced as a
whole, so ingesting a day twice leaves one copy. Maintenance merges a month's batches
into ``batch=compact-2024-02`` (``-r2`` and so on when it is merged again; readers see the name
without that). Compacted files keep the day each row was landed for, so a day that is landed
once more replaces its rows in there too, by a merge that follows the write at once.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from hodos.functions.calendar import as_date, day_spine, naive
from hodos.schemas import LAKE, LAKE_PARTITIONS, LANDING
from hodos.session import cut
from hodos.sources.files import Files

TARGET_FILE_BYTES = 512 * 1024 * 1024
#: Rows of a compacted file: one task sorts them all, and few bytes may hold many.
TARGET_FILE_ROWS = 4_000_000
#: Months that are merged at the same time.
MONTHS_AT_ONCE = 4
#: The day a row was landed for; only compacted files have it, readers of the lake don't.
LANDED_FOR = T.StructField("landed_for", T.StringType(), True)


class DataMissingError(Exception):
    """The source holds no records for a day that was asked for."""


# --- landing -------------------------------------------------------------------------


def read_landing(spark: SparkSession, path: str, schema: T.StructType = LANDING, multiline: bool = False) -> DataFrame:
    """Landed feed files below ``date=YYYY-MM-DD`` folders, as records plus ``date``.

    JSON lines by default; ``multiline`` reads files that hold one JSON array each. A
    malformed record stops the job rather than turning into nulls.
    """
    schema = T.StructType(schema.fields + [T.StructField("date", T.DateType(), True)])
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multiline).json(path)


def stamp(records: DataFrame, ingested_at: Column | datetime) -> DataFrame:
    """Mark records with their ingestion time (UTC); an argument, so replays repeat it."""
    return records.withColumn("ingested_at", naive(ingested_at))


def missing_days(days: DataFrame, start: Column | date, end: Column | date) -> DataFrame:
    """Days of [start, end] that do not occur in ``days.day``."""
    present = days.select(F.col("day").cast("date").alias("day")).distinct()
    return day_spine(days.sparkSession, start, end).join(present, "day", "left_anti")


# --- batches -------------------------------------------------------------------------


def write_batches(records: DataFrame, root: str, day: str = "date", settled: bool = True) -> None:
    """Write one batch per day; existing batches of the same days are replaced, also where
    they are part of a compacted month (``settled=False`` leaves that to the caller).

    The rebalance hint gathers each batch into few files and splits a batch that is much
    larger than the others over several tasks.
    """
    at = F.col(day)
    (
        records.withColumn("year", F.date_format(at, "yyyy"))
        .withColumn("month", F.date_format(at, "MM"))
        .withColumn("batch", F.date_format(at, "yyyy-MM-dd"))
        .drop(day)
        .hint("rebalance", *LAKE_PARTITIONS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy(*LAKE_PARTITIONS)
        .parquet(root)
    )
    if settled:
        settle(records.sparkSession, root)


def read_lake(spark: SparkSession, root: str, year: int | None = None, schema: T.StructType = LAKE) -> DataFrame:
    """The lake, or one year of it (a partition filter: other folders are not listed)."""
    lake = spark.read.schema(schema).parquet(root)
    lake = lake.withColumn("batch", F.regexp_replace("batch", r"^(compact-\d{4}-\d{2})-r\d+$", "$1"))
    return lake if year is None else lake.where(F.col("year") == year)


def ingest_day(spark: SparkSession, landing: str, root: str, day: date, ingested_at: Column | datetime, multiline: bool = False) -> None:
    """Land one day; a day without records is an error."""
    records = read_landing(spark, landing, multiline=multiline).where(F.col("date") == as_date(day))
    if records.isEmpty():
        raise DataMissingError(f"no records for {day}")
    write_batches(stamp(records, ingested_at), root)


@dataclass
class Backfill:
    missing: DataFrame
    compactions: list["Compaction"]


def backfill(
    spark: SparkSession,
    landing: str,
    root: str,
    start: date,
    end: date,
    ingested_at: Column | datetime,
    strict: bool = False,
    multiline: bool = False,
) -> Backfill:
    """Land a date range in one job, then compact the months it touched.

    Days the source lacks are skipped and returned, or raise when ``strict``. Days outside
    the range are never touched, not even in a month the range covers in part.
    """
    landed = read_landing(spark, landing, multiline=multiline).where(F.col("date").between(as_date(start), as_date(end)))
    # The days, from the folder names: a pass that parses no record, made once.
    present = cut(landed.select(F.col("date").alias("day")).distinct())
    missing = missing_days(present, start, end)
    if strict and not missing.isEmpty():
        raise DataMissingError(f"no records for {missing.count()} days in {start}..{end}")
    write_batches(stamp(landed, ingested_at), root, settled=False)
    months = present.select(F.year("day").alias("y"), F.month("day").alias("m")).distinct()
    # One row per calendar month of the range.
    return Backfill(missing, compact_months(spark, root, sorted((row.y, row.m) for row in months.collect())))


# --- maintenance ---------------------------------------------------------------------


@dataclass
class Compaction:
    year: int
    month: int
    files_before: int
    files_after: int
    rows: int | None  # None: nothing to do


def _finish(files: Files, month_dir: str, staged: str, plan: str) -> None:
    """Publish a compaction whose data is complete; safe to repeat after a crash.

    The plan folder holds one empty folder per batch to remove and one for the new name,
    and exists only once the merged files are verified. The merged batch is moved in
    before the originals go, so readers may for a moment see a row twice (staging keeps
    one) but never lose one.
    """
    names = files.folders(plan)
    target = next(n.removeprefix("new@") for n in names if n.startswith("new@"))
    if files.exists(staged):
        files.rename(staged, f"{month_dir}/batch={target}")
    for name in names:
        if name.startswith("old@"):
            files.delete(f"{month_dir}/{name.removeprefix('old@').replace('@', '=')}")
    files.delete(plan)


def _as_landed(spark: SparkSession, root: str, month_dir: str, schema: T.StructType) -> DataFrame:
    """A month's rows with ``batch`` and the day each was landed for (null where unknown)."""
    # Only the month's own folder is listed, not the lake.
    rows = spark.read.schema(T.StructType([*schema.fields, LANDED_FOR])).option("basePath", root).parquet(month_dir)
    own = F.when(~F.col("batch").startswith("compact-"), F.col("batch"))
    return rows.withColumn(LANDED_FOR.name, F.coalesce(own, LANDED_FOR.name))


def _replaced(batches: list[str]) -> Column:
    """Whether a compacted row's day has been landed again since; at most 31 days."""
    days = [b.removeprefix("batch=") for b in batches if not b.startswith("batch=compact-")]
    again = F.col("batch").startswith("compact-") & F.col(LANDED_FOR.name).isin(days)
    return F.coalesce(again, F.lit(False)) if days else F.lit(False)


def settle(spark: SparkSession, root: str) -> list["Compaction"]:
    """Merge the months whose compacted rows have been landed again as days.

    Looks at folder names, and only in months with both kinds of batches at the rows'
    landing days. An interrupted write is settled by the next one.
    """
    files, open_months = Files(spark), []
    for year in files.folders(root):
        for month in files.folders(f"{root}/{year}") if year.startswith("year=") else []:
            month_dir = f"{root}/{year}/{month}"
            batches = files.folders(month_dir)
            kinds = {b.startswith("batch=compact-") for b in batches}
            if len(kinds) == 2 and not _as_landed(spark, root, month_dir, LAKE).where(_replaced(batches)).isEmpty():
                open_months.append((int(year.removeprefix("year=")), int(month.removeprefix("month="))))
    return compact_months(spark, root, open_months)


def compact_months(spark: SparkSession, root: str, months: list[tuple[int, int]], **how) -> list["Compaction"]:
    """Compact (year, month) pairs, a few of them at the same time."""
    with ThreadPoolExecutor(MONTHS_AT_ONCE) as pool:
        return list(pool.map(lambda at: compact_month(spark, root, *at, **how), months))


def compact_month(
    spark: SparkSession,
    root: str,
    year: int,
    month: int,
    target_file_bytes: int = TARGET_FILE_BYTES,
    schema: T.StructType = LAKE,
    sort_by: tuple[str, ...] = ("ingested_at", "deviceid", "appprocesstime"),
) -> Compaction:
    """Merge all files of a month, sorted by ingestion time; the rows stay the same, but for
    compacted ones of days that were landed again.

    A month within the target size and ``TARGET_FILE_ROWS`` becomes one file, a larger one as
    many as it needs, cut by ranges of the sort columns. Nothing is removed before the merged copy is
    written and counted.
    """
    files = Files(spark)
    month_dir = f"{root}/year={year:04d}/month={month:02d}"
    work = f"{root}/_compacting/{year:04d}-{month:02d}"
    staged, plan, draft = f"{work}/rows", f"{work}/plan", f"{work}/draft"
    if files.exists(plan):
        _finish(files, month_dir, staged, plan)

    batches = files.folders(month_dir)
    sizes = files.parquet_sizes(month_dir)
    n_rows = _as_landed(spark, root, month_dir, schema).count() if sizes else 0  # footers
    wanted = max(1, -(-sum(sizes) // target_file_bytes), -(-n_rows // TARGET_FILE_ROWS))
    compacted = [b for b in batches if b.startswith("batch=compact-")]
    if not batches or (len(batches) == len(compacted) == 1 and len(sizes) <= wanted):
        return Compaction(year, month, len(sizes), len(sizes), None)

    files.delete(work)  # leftovers without a plan are incomplete
    rows = _as_landed(spark, root, month_dir, schema).where(~_replaced(batches)).drop(*LAKE_PARTITIONS)
    keys = [name for name in sort_by if name in rows.columns]
    (
        rows.repartitionByRange(wanted, *keys)
        .sortWithinPartitions(*keys)
        .write.option("compression", "snappy")
        .parquet(staged)
    )
    kept, expected = spark.read.parquet(staged).count(), rows.count()  # footers, or one narrow column
    if kept != expected:
        raise RuntimeError(f"compaction of {year}-{month:02d} wrote {kept} of {expected} rows; originals kept")

    base = f"compact-{year:04d}-{month:02d}"
    taken = {b.removeprefix("batch=") for b in batches}
    name = next(n for n in [base, *[f"{base}-r{i}" for i in range(2, len(taken) + 3)]] if n not in taken)
    for entry in [f"new@{name}", *[f"old@{b.replace('=', '@')}" for b in batches]]:
        files.make(f"{draft}/{entry}")
    files.rename(draft, plan)  # from here on the compaction completes, whatever happens
    _finish(files, month_dir, staged, plan)
    return Compaction(year, month, len(sizes), len(files.parquet_sizes(month_dir)), kept)
