"""Warehouse tables as Parquet folders: full replace and keyed upsert.

Without a transactional table format two things need care: a plan must not overwrite the
files it reads, and a crash must not lose a partition. So every write goes to a staging
folder first, whose partitions then take the place of the target's. A
staging folder that is complete (``_SUCCESS``) but still there marks a move that is going on
or was interrupted; the table's next write repeats it. Readers never publish: they would race
the writer. A table has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from hodos.operators.dedup import keep_first
from hodos.schemas import FACTS, ROADS, STAGING
from hodos.sources.files import Files

@dataclass(frozen=True)
class Table:
    """``derived`` names a partition column computed from the key. It exists on disk only."""

    name: str
    schema: T.StructType | str | None = None
    partition_by: tuple[str, ...] = ()
    derived: str | None = None


# Tables that are merged lie by the day of the reading, so a daily batch rewrites a few days
# and not months. The day follows from the key: a row never moves to another partition.
# (The year and month a staging row carries are those of its delivery folder, which a late
# correction may change.)
DAY = T.StructField("day", T.StringType(), True)
STG_TRAFFIC = Table("stg_traffic", T.StructType([*STAGING.fields, DAY]), ("day",), derived="day")
DIM_ROADS = Table("dim_roads", ROADS)
FCT_MEASUREMENTS = Table("fct_measurements", T.StructType([*FACTS.fields, DAY]), ("day",), derived="day")
MRT_TRAFFIC_ROAD = Table("mrt_traffic_road", None, ("processed_year", "processed_month"))


class Warehouse:
    """Tables of one target (``dev`` or ``prod``) below a root folder."""

    def __init__(self, spark: SparkSession, root: str, target: str = "prod"):
        self.spark, self.root = spark, f"{root.rstrip('/')}/{target}"
        self._files = Files(spark)

    def path(self, table: Table) -> str:
        return f"{self.root}/{table.name}"

    def _staging(self, table: Table, kind: str) -> str:
        return f"{self.root}/_staging/{table.name}/{kind}"

    def exists(self, table: Table) -> bool:
        return self._files.exists(f"{self.path(table)}/_SUCCESS")

    def read(self, table: Table, since: datetime | None = None, days: Sequence[str | None] | None = None) -> DataFrame:
        """The table; where rows lie by day, ``since`` leaves out the days before a moment and
        ``days`` all but the given ones (None: rows without a time)."""
        rows = self._load(table)
        if table.derived is None:
            return rows
        if since is not None:
            rows = rows.where(F.col(table.derived) >= since.strftime("%Y-%m-%d"))
        if days is not None:
            place = F.col(table.derived)
            dated = place.isin([d for d in days if d is not None])
            rows = rows.where(dated | place.isNull() if None in days else dated)
        return rows.drop(table.derived)

    def _load(self, table: Table) -> DataFrame:
        return self._reader(table).parquet(self.path(table))

    def _placed(self, table: Table, df: DataFrame) -> DataFrame:
        return df if table.derived is None else df.withColumn(table.derived, F.col("processed_at").cast("date").cast("string"))

    def replace(self, table: Table, df: DataFrame, sort_by: Sequence[str] = ()) -> None:
        """Full rebuild."""
        self.recover(table)
        df = self._placed(table, df)
        if sort_by:
            # Led by the partition columns: the writer would otherwise sort by them again
            # and lose the order asked for.
            df = df.sortWithinPartitions(*table.partition_by, *sort_by)
        elif table.partition_by:
            df = df.hint("rebalance", *table.partition_by)
        self._stage(table, df, "replace")
        self._publish_replace(table)

    def upsert(self, table: Table, batch: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> None:
        """Merge ``batch`` on ``keys``: matched rows are replaced, others added.

        With ``order`` the first row per key under that order wins, whichever side it
        comes from; then batches may arrive in any sequence. Only the partitions the batch
        touches are read and rewritten, so a key has to determine its partition. ``batch``
        is read more than once; hand in something already written or checkpointed.
        """
        self.recover(table)
        if not self.exists(table):
            self.replace(table, batch)
            return
        current, batch = self._load(table), self._placed(table, batch)
        if table.partition_by:
            # One row per day in the batch.
            touched = batch.select(*table.partition_by).distinct().collect()
            if not touched:
                return
            place = F.struct(*table.partition_by) if len(table.partition_by) > 1 else F.col(table.partition_by[0])
            values = [tuple(row) if len(row) > 1 else row[0] for row in touched]
            inside = place.isin([v for v in values if v is not None])
            current = current.where(inside | place.isNull() if None in values else inside)
        if order is not None:
            merged = keep_first(current.unionByName(batch), keys, order)
        else:
            merged = current.join(batch.select(*keys), list(keys), "left_anti").unionByName(batch)
        if table.partition_by:
            merged = merged.hint("rebalance", *table.partition_by)
        self._stage(table, merged.select(*current.columns), "merge")
        self._publish_merge(table)

    def rewrite(self, table: Table, batch: DataFrame, first: datetime, last: datetime) -> None:
        """Rows from ``first`` to ``last`` of a table that lies by day are replaced by ``batch``,
        which has the same range and is read once; other rows of those days stay."""
        self.recover(table)
        day, at = F.col(table.derived), F.col("processed_at")
        current = self._load(table).where(day.between(first.strftime("%Y-%m-%d"), last.strftime("%Y-%m-%d")))
        inside = at.between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))
        merged = current.where(~inside).unionByName(self._placed(table, batch).select(*current.columns))
        self._stage(table, merged, "merge")
        self._publish_merge(table)

    def replace_partitions(self, table: Table, df: DataFrame, whole: bool = False) -> None:
        """The partitions ``df`` has rows of, or the ``whole`` table, are replaced by its rows."""
        self.recover(table)
        df = df.hint("rebalance", *table.partition_by)
        if whole or not self.exists(table):
            self.replace(table, df)
            return
        self._stage(table, df, "merge")
        self._publish_merge(table)

    def latest(self, table: Table, column: str, empty: datetime = datetime(1970, 1, 1)) -> datetime:
        """High-water mark of a column; ``empty`` for a missing or empty table."""
        if not self.exists(table):
            return empty
        return self._load(table).agg(F.max(column)).first()[0] or empty

    # -- staging ------------------------------------------------------------------

    def _stage(self, table: Table, df: DataFrame, kind: str) -> None:
        staged = self._staging(table, kind)
        self._files.delete(staged)  # an incomplete earlier attempt
        self._writer(table, df).parquet(staged)

    def _publish_replace(self, table: Table) -> None:
        self._files.delete(self.path(table))
        self._files.rename(self._staging(table, "replace"), self.path(table))

    def _publish_merge(self, table: Table) -> None:
        """Move the staged partitions to the target's place; repeating it changes nothing, as what
        has been moved is no longer staged."""
        staged = self._staging(table, "merge")
        if not table.partition_by:
            self._files.delete(self.path(table))
            self._files.rename(staged, self.path(table))
            return
        places = [""]
        for _ in table.partition_by:
            places = [f"{at}/{name}" for at in places for name in self._files.folders(f"{staged}{at}") if "=" in name]
        for at in places:
            self._files.delete(f"{self.path(table)}{at}")
            self._files.rename(f"{staged}{at}", f"{self.path(table)}{at}")
        self._files.delete(staged)

    def recover(self, *tables: Table) -> None:
        """Finish interrupted writes; for the writer of the tables alone."""
        for table in tables:
            self._recover(table)

    def _recover(self, table: Table) -> None:
        if self._files.exists(f"{self._staging(table, 'replace')}/_SUCCESS"):
            self._publish_replace(table)
        if self._files.exists(f"{self._staging(table, 'merge')}/_SUCCESS"):
            self._publish_merge(table)

    def _reader(self, table: Table):
        return self.spark.read if table.schema is None else self.spark.read.schema(table.schema)

    def _writer(self, table: Table, df: DataFrame):
        writer = df.write.mode("overwrite").option("compression", "snappy")
        return writer.partitionBy(*table.partition_by) if table.partition_by else writer
