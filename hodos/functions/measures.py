"""The measures every report shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

IMPOSSIBLE_SPEED = 130


def speed_volume() -> Column:
    return F.col("average_speed") * F.col("counted_cars")


def weighted_speed() -> Column:
    """Volume-weighted mean speed; null when no car was counted.

    A reading with a null speed drops out of the numerator only, its cars still count.
    """
    return F.sum(speed_volume()) / F.nullif(F.sum("counted_cars"), F.lit(0))


def share(part: Column, whole: Column) -> Column:
    return F.lit(100) * part / whole


def quality_flags() -> dict[str, Column]:
    """Flags of one reading. Null measures satisfy no rule, so they come out false."""
    cars, speed = F.col("counted_cars"), F.col("average_speed")
    ghost = ((cars == 0) & (speed > 0)) | ((cars > 0) & (speed == 0))
    dead = (cars == 0) & (speed == 0)
    impossible = speed > IMPOSSIBLE_SPEED
    holds = lambda rule: F.coalesce(rule, F.lit(False))
    missing = F.col("ingested_at").isNull()
    return {
        "is_ghost_reading": holds(ghost),
        "is_dead": holds(dead),
        "is_impossible_speed": holds(impossible),
        "is_missing": missing,
        "is_quality": ~(holds(ghost) | holds(dead) | holds(impossible) | missing | cars.isNull()),
    }


def published(value: Column, digits: int = 6) -> Column:
    """A double as it is published: rounded, with half-way values going up.

    Float sums depend on the order of addition, so a mean that ends in an exact 5 comes
    out a hair above or below it. The nudge, far smaller than the last digit, settles
    those the same way every time. Never use this before an ordering or an equality test.
    """
    return F.round(value + F.lit(1e-9), digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """A finished result with its double columns as published."""
    return df.select(
        *[
            published(F.col(f"`{field.name}`"), digits).alias(field.name)
            if isinstance(field.dataType, T.DoubleType)
            else F.col(f"`{field.name}`")
            for field in df.schema.fields
        ]
    )
