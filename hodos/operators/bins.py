"""Histogram and hexagonal density of model results, for charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def density_histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed. Density integrates to 1.

    When all values are equal the range is widened by half a unit on both sides.
    """
    present = df.where(F.col(value).isNotNull())
    ends = present.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).alias("e"))
    flat = F.col("e.lo") == F.col("e.hi")
    lo = F.when(flat, F.col("e.lo") - 0.5).otherwise(F.col("e.lo"))
    hi = F.when(flat, F.col("e.hi") + 0.5).otherwise(F.col("e.hi"))
    # One struct, attached as a column: every use of a scalar would be a subquery to plan.
    ends = ends.select(F.struct(lo.alias("lo"), ((hi - lo) / bins).alias("width"), F.col("e.n").alias("n"))).scalar()
    placed = present.withColumn("_e", ends).select(
        F.least(F.floor((F.col(value) - F.col("_e.lo")) / F.col("_e.width")), F.lit(bins - 1)).cast("int").alias("bin")
    )
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("_e", ends)
    return counts.select(
        "bin",
        (F.col("_e.lo") + F.col("bin") * F.col("_e.width")).alias("bin_start"),
        (F.col("_e.lo") + (F.col("bin") + 1) * F.col("_e.width")).alias("bin_end"),
        "n_rows",
        (F.col("n_rows") / (F.col("_e.n") * F.col("_e.width"))).alias("density"),
    )


def hexagon_density(df: DataFrame, x: str, y: str, columns: int = 75) -> DataFrame:
    """Counts per hexagon of a regular tiling, empty hexagons left out.

    Hexagon centres form two interleaved rectangular lattices, the second one shifted by
    half a cell both ways. A point belongs to the nearer of its candidates in the two,
    with vertical distance counted three-fold because cells are sqrt(3) times as tall.
    """
    rows = int(columns / 3**0.5)
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    # A line or a single point still needs cells of some size.
    reach = lambda name: F.when(F.max(name) > F.min(name), F.max(name) - F.min(name)).otherwise(F.lit(1.0))
    frame = points.agg(
        F.struct(
            F.min(x).alias("x0"),
            F.min(y).alias("y0"),
            (reach(x) / columns).alias("step_x"),
            (reach(y) / rows).alias("step_y"),
        )
    ).scalar()
    u = (F.col(x) - F.col("_f.x0")) / F.col("_f.step_x")
    v = (F.col(y) - F.col("_f.y0")) / F.col("_f.step_y")

    placed = points.withColumn("_f", frame).select(u.alias("u"), v.alias("v")).select(
        "u",
        "v",
        F.bround("u").alias("corner_u"),
        F.bround("v").alias("corner_v"),
        # The shifted lattice ends half a cell inside the upper edges.
        (F.least(F.floor("u"), F.lit(columns - 1)) + 0.5).alias("centre_u"),
        (F.least(F.floor("v"), F.lit(rows - 1)) + 0.5).alias("centre_v"),
    )
    gap = lambda a, b: F.pow(F.col("u") - F.col(a), 2) + 3 * F.pow(F.col("v") - F.col(b), 2)
    on_corner = gap("corner_u", "corner_v") < gap("centre_u", "centre_v")
    return (
        placed.groupBy(
            F.when(on_corner, F.col("corner_u")).otherwise(F.col("centre_u")).alias("hex_x"),
            F.when(on_corner, F.col("corner_v")).otherwise(F.col("centre_v")).alias("hex_y"),
        )
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("_f", frame)
        .select(
            "hex_x",
            "hex_y",
            (F.col("_f.x0") + F.col("hex_x") * F.col("_f.step_x")).alias("x_centre"),
            (F.col("_f.y0") + F.col("hex_y") * F.col("_f.step_y")).alias("y_centre"),
            "n_rows",
            F.log10("n_rows").alias("log_rows"),
        )
    )
