"""Tables bucketed by a key, so that joins and windows by that key need no exchange.

A table read back from plain Parquet carries no distribution: every sort-merge join and every
window over it shuffles it again. Here rows are shuffled once, when they are written, into a
fixed number of buckets; tables of the same key and number of buckets then meet bucket by bucket.
The catalog of a session may not outlive it, so the layout is part of the folder's name and
``read`` declares the table anew from that.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from hodos.session import shuffle_tasks
from hodos.sources.files import Files


def _name(path: str) -> str:
    return f"hodos_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def write(rows: DataFrame, folder: str, key: str, buckets: int | None = None) -> DataFrame:
    """Write ``rows`` below ``folder`` (a fresh one) and return them as a bucketed table.

    One task writes a bucket, and one file. Buckets of different tables only match if their
    number is the same, so it should follow from the largest of the tables that are to be joined
    (its bytes over what a task should hold); by default it is the session's number of shuffle
    tasks. A key's rows are in one bucket: choose a key whose rows are bounded, as a device's are
    by the hours of the series.
    """
    spark = rows.sparkSession
    buckets = buckets or shuffle_tasks(spark)
    path = f"{folder}/{key}-{buckets}"
    laid_out = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    laid_out.format("parquet").option("path", path).saveAsTable(_name(path))
    return spark.table(_name(path))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The table that ``write`` left below ``folder``, in any session. A write that was not
    completed is an error."""
    files = Files(spark)
    layouts = [name for name in files.folders(folder) if files.exists(f"{folder}/{name}/_SUCCESS")]
    if len(layouts) != 1:
        raise FileNotFoundError(f"{folder} holds {len(layouts)} complete bucketed tables")
    path = f"{folder}/{layouts[0]}"
    if not spark.catalog.tableExists(_name(path)):
        key, buckets = layouts[0].rsplit("-", 1)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(
            f"CREATE TABLE {_name(path)} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
            f"INTO {int(buckets)} BUCKETS LOCATION '{path}'"
        )
    return spark.table(_name(path))
