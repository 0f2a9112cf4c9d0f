"""Data tests: one result row per tested column, all as aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hodos.functions.calendar import full_hour


def _result(table: str, column: str, test: str) -> list[Column]:
    return [
        F.lit(table).alias("table_name"),
        F.lit(column).alias("column_name"),
        F.lit(test).alias("test_name"),
        F.col("failing_rows").cast("bigint").alias("failing_rows"),
        F.when(F.col("failing_rows") == 0, "pass").otherwise("fail").alias("status"),
    ]


def unique(df: DataFrame, table: str, *keys: str) -> DataFrame:
    """Number of non-null key values that occur more than once."""
    present = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in keys])
    repeated = df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return repeated.agg(F.count(F.lit(1)).alias("failing_rows")).select(*_result(table, ",".join(keys), "unique"))


#: Hours of a day that are counted in one long, 32 bits each.
_LANES = 2


def past_hour(at: Column) -> Column:
    """What a moment has beyond its full hour."""
    return at - full_hour(at)


def hour_counts(at: Column) -> list[Column]:
    """Aggregates that tell how often each hour of the day occurs, in a fixed number of longs. A
    group of one day and one ``past_hour`` thus has a count for each of its moments."""
    lane = F.when(F.hour(at) % _LANES == 0, F.lit(1).cast("bigint")).otherwise(F.lit(1 << 32))
    return [F.sum(F.when(F.floor(F.hour(at) / _LANES) == k, lane)).alias(f"hours{k}") for k in range(24 // _LANES)]


def repeated_hours() -> Column:
    """Of what ``hour_counts`` counted, the number of hours that occur more than once."""
    held = [F.coalesce(F.col(f"hours{k}"), F.lit(0)) for k in range(24 // _LANES)]
    lanes = [lane for h in held for lane in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    return reduce(lambda a, b: a + b, [(lane > 1).cast("bigint") for lane in lanes])


def unique_hourly(df: DataFrame, table: str, key: str, at: str) -> DataFrame:
    """:func:`unique` on (``key``, ``at``) of dense hourly rows: a group for each key and day, not
    for each row. Moments off the hour are told apart too."""
    time = F.col(at)
    days = df.where(F.col(key).isNotNull() & time.isNotNull()).groupBy(key, time.cast("date"), past_hour(time)).agg(*hour_counts(time))
    failing = days.agg(F.coalesce(F.sum(repeated_hours()), F.lit(0)).alias("failing_rows"))
    return failing.select(*_result(table, f"{key},{at}", "unique"))


def not_null(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Nulls of every listed column in one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in columns])
    long = counts.unpivot([], list(columns), "column_name", "failing_rows")
    return long.select(
        F.lit(table).alias("table_name"),
        "column_name",
        F.lit("not_null").alias("test_name"),
        F.col("failing_rows").cast("bigint").alias("failing_rows"),
        F.when(F.col("failing_rows") == 0, "pass").otherwise("fail").alias("status"),
    )


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def relationship(child: DataFrame, parent: DataFrame, key: str, table: str) -> DataFrame:
    # Distinct child keys with their row counts first: the join then sees one row per key.
    keys = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    lost = orphans(keys, parent, key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failing_rows"))
    return lost.select(*_result(table, key, "relationships"))


def report(results: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


class DataTestError(Exception):
    """A data test failed in a run that asked to stop on failures."""


def require(results: DataFrame) -> None:
    failed = results.where("status = 'fail'").collect()  # one row per declared test
    if failed:
        raise DataTestError("; ".join(f"{r.table_name}.{r.column_name} {r.test_name}: {r.failing_rows}" for r in failed))
