"""What a run did, as one table: rows it dropped, rows that came late, files it merged."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from hodos.sources.lake import Compaction


class RunReport:
    """Measures of the steps of a run. Those of ``observe`` are taken while the step's own job
    runs, by the rows that pass; no row is read a second time for them."""

    def __init__(self, run_id: str):
        self.run_id = run_id
        self._seen: list[tuple[str, Observation]] = []
        self._noted: list[tuple[str, str, int | None]] = []

    def observe(self, step: str, df: DataFrame, **measures: Column) -> DataFrame:
        """``df`` unchanged; its first action yields the measures (aggregates)."""
        seen = Observation(f"{self.run_id}-{step}-{len(self._seen)}")
        self._seen.append((step, seen))
        return df.observe(seen, *[value.alias(name) for name, value in measures.items()])

    def observation(self, step: str) -> Observation:
        """For a step that observes its rows itself."""
        seen = Observation(f"{self.run_id}-{step}-{len(self._seen)}")
        self._seen.append((step, seen))
        return seen

    def note(self, step: str, measure: str, value: int | None) -> None:
        self._noted.append((step, measure, value))

    def compactions(self, done: Iterable[Compaction]) -> None:
        """Files of all compacted months before and after, and the rows they hold."""
        done = list(done)
        self.note("compaction", "files_before", sum(c.files_before for c in done))
        self.note("compaction", "files_after", sum(c.files_after for c in done))
        self.note("compaction", "n_rows", sum(c.rows or 0 for c in done))

    def table(self, spark: SparkSession) -> DataFrame:
        """(run_id, step, measure, value), a row for each measure; waits for steps that still run."""
        rows = [(self.run_id, step, name, value) for step, seen in self._seen for name, value in seen.get.items()]
        rows += [(self.run_id, *noted) for noted in self._noted]
        return spark.createDataFrame(rows, "run_id string, step string, measure string, value bigint").orderBy(F.col("step"), F.col("measure"))
