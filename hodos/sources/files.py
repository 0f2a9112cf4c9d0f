"""Folder operations through Hadoop's FileSystem, so any storage Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._path(path)
        return at.getFileSystem(self._conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def folders(self, path: str) -> list[str]:
        """Names of the sub-folders, sorted."""
        fs, at = self._at(path)
        if not fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())

    def parquet_sizes(self, path: str) -> list[int]:
        """Sizes of the Parquet files anywhere below ``path``."""
        fs, at = self._at(path)
        if not fs.exists(at):
            return []
        sizes, entries = [], fs.listFiles(at, True)
        while entries.hasNext():
            status = entries.next()
            if status.getPath().getName().endswith(".parquet"):
                sizes.append(status.getLen())
        return sizes

    def make(self, path: str) -> None:
        fs, at = self._at(path)
        fs.mkdirs(at)

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def rename(self, source: str, target: str) -> None:
        fs, at = self._at(source)
        to = self._path(target)
        fs.mkdirs(to.getParent())
        if not fs.rename(at, to):
            raise OSError(f"cannot rename {source} to {target}")
