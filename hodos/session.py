"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the one session setting results depend on: naive timestamps mean UTC. Workers that
    lack this package find it where the driver has it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hodos")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shuffle_tasks(spark: SparkSession) -> int:
    """The number of tasks the session is set up to shuffle into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Folders of local sessions that name none.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to the machine's own temporary folder; on a
    cluster that would lose data with the first lost executor, so it is an error there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="hodos-")
        folder = _own[context.applicationId]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder (created by the first write)."""
    return f"{shared_folder(spark)}/hodos-{label}-{uuid.uuid4().hex}"


def cut(df):
    """Reliable checkpoint: evaluates ``df`` once and survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
