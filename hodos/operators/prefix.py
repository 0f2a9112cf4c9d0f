"""Distributed running totals over one global order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from hodos.session import shuffle_tasks


def running_totals(df: DataFrame, order: str, totals: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Cumulative sums over a unique numeric column, plus the next value in the order.

    A window without PARTITION BY would pull everything into one task. Instead the order
    column is cut into ``buckets`` ranges (two for every shuffle task) at approximate quantiles; range totals (at most
    ``buckets`` rows) are accumulated first and added to windows that run inside each
    range. The cut points only balance the work: the sums are exact wherever they fall.

    Adds ``cum_<name>`` for every total and ``next_<order>``. ``df`` is read three times, so
    hand in something already aggregated and written or checkpointed.
    """
    buckets = buckets or 2 * shuffle_tasks(df.sparkSession)
    steps = [i / buckets for i in range(1, buckets)]
    # One row of `buckets` numbers.
    cuts = df.agg(F.percentile_approx(order, F.array(*[F.lit(s) for s in steps]), F.lit(buckets * 10))).first()[0] or []
    value = F.col(order)
    points = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array(value)
    ranged = df.withColumn("_range", F.size(F.filter(points, lambda c: c < value)))

    in_order = Window.orderBy("_range")  # at most `buckets` rows, already aggregated
    ranges = (
        ranged.groupBy("_range")
        .agg(F.min(order).alias("_low"), *[F.sum(name).alias(f"_sum_{name}") for name in totals])
        .select(
            "_range",
            F.lead("_low").over(in_order).alias("_next_low"),
            *[
                (F.sum(f"_sum_{name}").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"_sum_{name}")).alias(f"_before_{name}")
                for name in totals
            ],
        )
    )
    inside = Window.partitionBy("_range").orderBy(order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(ranges), "_range").select(
        *df.columns,
        F.coalesce(F.lead(order).over(inside), F.col("_next_low")).alias(f"next_{order}"),
        *[(F.col(f"_before_{name}") + F.sum(name).over(running)).alias(f"cum_{name}") for name in totals],
    )
