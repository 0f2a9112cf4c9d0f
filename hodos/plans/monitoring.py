"""Drift monitoring of the model's inputs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from hodos.operators.drift import column_drift, drift_summary, drift_tests, shared_columns
from hodos.plans.features import recent
from hodos.session import cut


def current_rows(mart: DataFrame, as_of: Column | date, lookback_days: int = 14) -> DataFrame:
    return recent(mart, as_of, lookback_days).select("device_id", "road_name", "average_speed")


def comparable(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Current rows with the columns the reference sample has, in its order."""
    return current.select(*shared_columns(reference, current))


def drift_report(reference: DataFrame, current: DataFrame, threshold: float = 0.1, alert_share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(one row per column, the alert row). Column results are a handful of rows; they are
    kept so that the alert does not compute them again."""
    columns = cut(column_drift(reference, comparable(reference, current), threshold))
    return columns, drift_summary(columns, alert_share)


def drift_by_size(reference: DataFrame, current: DataFrame, tests_up_to: int = 1_000, alpha: float = 0.05, threshold: float = 0.1) -> DataFrame:
    """One row per column: judged by a test of significance while the reference has at most
    ``tests_up_to`` rows, by a distance beyond, where tests find any difference significant."""
    current = comparable(reference, current)
    small = reference.limit(tests_up_to + 1).count() <= tests_up_to
    if not small:
        return column_drift(reference, current, threshold).select("column_name", "method", "score", "is_drifted")
    kinds = dict(current.dtypes)
    numbers = [c for c, k in kinds.items() if k in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    tests = drift_tests(reference, current, numbers, [c for c in kinds if c not in numbers], alpha)
    return tests.select("column_name", F.col("test").alias("method"), F.col("p_value").alias("score"), "is_drifted")
