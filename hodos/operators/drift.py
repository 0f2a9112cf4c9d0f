"""Distribution drift between a reference sample and current rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hodos.operators.prefix import running_totals
from hodos.session import cut


def shared_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    """Columns of ``current`` the reference has too, in the reference's order."""
    return [name for name in reference.columns if name in current.columns]


def _two_sided(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per column and distinct value on either side: (column_name, value, ref, cur).

    Both inputs are read once for all columns. What follows works on distinct values, so a
    value that holds a third of the rows costs one row; the counts are kept because the
    measures pass over them several times.
    """
    side = lambda df, a, b: (
        df.select(*columns).unpivot([], list(columns), "column_name", "value").select("*", F.lit(a).alias("ref"), F.lit(b).alias("cur"))
    )
    return cut(
        side(reference, 1, 0)
        .unionByName(side(current, 0, 1))
        .where("value IS NOT NULL")
        .groupBy("column_name", "value")
        .agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    )


def numeric_drift(reference: DataFrame, current: DataFrame, column: str, threshold: float = 0.1) -> DataFrame:
    """Wasserstein distance over the reference's standard deviation, and the KS statistic.

    The distance is the area between the two empirical distribution functions.
    """
    counts = _two_sided(reference, current, [column]).drop("column_name")
    value, ref = F.col("value"), F.col("ref")
    n_ref, n_cur, mean = counts.agg(F.sum(ref), F.sum("cur"), F.sum(ref * value) / F.nullif(F.sum(ref), F.lit(0))).first()
    # Centred first: a difference of large squares would lose the digits that matter.
    spread = counts.agg(F.sum(ref * F.pow(value - F.lit(mean or 0.0), F.lit(2.0))) / F.nullif(F.sum(ref), F.lit(0))).first()[0]
    # A constant reference column must not divide by zero.
    deviation = max((spread or 0.0) ** 0.5, 0.001)
    curves = running_totals(counts, "value", ("ref", "cur"))
    # Without rows on one side there is nothing to compare: the result is null.
    distance = F.abs(F.col("cum_ref") / F.nullif(F.lit(n_ref), F.lit(0)) - F.col("cum_cur") / F.nullif(F.lit(n_cur), F.lit(0)))
    area = F.sum(distance * F.coalesce(F.col("next_value") - value, F.lit(0.0)))
    return curves.agg((area / deviation).alias("score"), F.max(distance).alias("statistic")).select(
        F.lit(column).alias("column_name"),
        F.lit("wasserstein").alias("method"),
        "score",
        "statistic",
        (F.col("score") >= threshold).alias("is_drifted"),
    )


def categorical_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str], threshold: float = 0.1) -> DataFrame:
    """Jensen-Shannon distance (natural logarithm) and the two-sample chi-square statistic,
    one row per column."""
    counts = _two_sided(reference, current, columns)
    # One row per column, named for the join.
    sizes = counts.groupBy(F.col("column_name").alias("sized")).agg(F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"))
    sized = counts.join(F.broadcast(sizes), F.col("column_name") == F.col("sized"))
    n_ref, n_cur = F.col("n_ref"), F.col("n_cur")
    p, q = F.col("ref") / F.nullif(n_ref, F.lit(0)), F.col("cur") / F.nullif(n_cur, F.lit(0))
    middle = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log(x / middle)).otherwise(F.lit(0.0))
    divergence = F.sum((part(p) + part(q)) / 2)
    both = F.col("ref") + F.col("cur")
    expected_ref, expected_cur = both * n_ref / (n_ref + n_cur), both * n_cur / (n_ref + n_cur)
    chi_square = F.sum(
        F.pow(F.col("ref") - expected_ref, 2) / F.nullif(expected_ref, F.lit(0)) + F.pow(F.col("cur") - expected_cur, 2) / F.nullif(expected_cur, F.lit(0))
    )  # null without rows on one side
    score = F.sqrt(F.greatest(F.col("divergence"), F.lit(0.0)))
    return (
        sized.groupBy("column_name")
        .agg(divergence.alias("divergence"), chi_square.alias("statistic"))
        .select(
            "column_name",
            F.lit("jensenshannon").alias("method"),
            score.alias("score"),
            "statistic",
            (score >= threshold).alias("is_drifted"),
        )
    )


def column_drift(reference: DataFrame, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """One row per shared column, by the column's kind."""
    number_kinds = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    kinds, shared = dict(reference.dtypes), shared_columns(reference, current)
    numbers = [name for name in shared if kinds[name] in number_kinds]
    categories = [name for name in shared if kinds[name] not in number_kinds]
    results = [numeric_drift(reference, current, name, threshold) for name in numbers]
    if categories:
        results.append(categorical_drift(reference, current, categories, threshold))
    return reduce(DataFrame.unionByName, results)


def drift_summary(columns: DataFrame, alert_share: float = 0.5) -> DataFrame:
    """The alert row: how many columns drifted, and whether that is more than the limit."""
    drifted, total = F.count_if("is_drifted"), F.count(F.lit(1))
    share = drifted / total
    return columns.agg(
        total.alias("n_columns"),
        drifted.alias("n_drifted"),
        share.alias("drift_share"),
        (share > alert_share).alias("is_drifting"),
        F.format_string("%.2f", share).alias("drift_share_text"),
    )


# --- tests of significance ----------------------------------------------------------------


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series ten steps up."""
    z = x + 10
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    raised = (z - 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + series  # half the logarithm of 2 pi
    return raised - reduce(lambda a, b: a + b, [F.log(x + k) for k in range(10)])


def chi_square_p_value(statistic: Column, freedom: Column) -> Column:
    """How likely a chi-square variable is at least ``statistic``: one minus the regularised
    incomplete gamma function, summed as x^(a+n) e^-x / gamma(a+n+1) until terms vanish."""
    a, x = freedom.cast("double") / 2, statistic.cast("double") / 2
    terms = F.ceil(F.greatest(x - a, F.lit(0.0)) + 12 * F.sqrt(x + a) + 50).cast("int")
    below = F.aggregate(
        F.sequence(F.lit(0), terms),
        F.lit(0.0),
        lambda total, n: total + F.exp((a + n) * F.log(x) - x - log_gamma(a + n + 1)),
    )
    return F.when(freedom < 1, F.lit(1.0)).when(x <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - below))


def kolmogorov_p_value(statistic: Column, n_ref: Column, n_cur: Column) -> Column:
    """How likely two samples of one distribution differ by ``statistic`` or more (asymptotic)."""
    root = F.sqrt(n_ref.cast("double") * n_cur / (n_ref + n_cur))
    scaled = (root + 0.12 + 0.11 / root) * statistic
    term = lambda total, k: total + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * scaled * scaled)
    series = 2 * F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), term)
    # below this the series has not converged, and the probability is 1 to ten digits
    return F.when(scaled < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def drift_tests(reference: DataFrame, current: DataFrame, numbers: Sequence[str], categories: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Kolmogorov-Smirnov tests of numbers and chi-square tests of categories, one row a column.
    Null p-values stand for a side without values."""
    rows = []
    for name in numbers:
        sizes = [df.agg(F.count(name)).first()[0] for df in (reference, current)]
        n_ref, n_cur = (F.lit(n).cast("double") for n in sizes)
        p = kolmogorov_p_value(F.col("statistic"), n_ref, n_cur) if all(sizes) else F.lit(None).cast("double")
        found = numeric_drift(reference, current, name)
        rows.append(found.select("column_name", F.lit("kolmogorov_smirnov").alias("test"), "statistic", F.lit(None).cast("bigint").alias("freedom"), p.alias("p_value")))
    if categories:
        found = categorical_drift(reference, current, categories)
        kinds = _two_sided(reference, current, categories).groupBy("column_name").agg((F.count(F.lit(1)) - 1).alias("freedom"))
        p = F.when(F.col("statistic").isNotNull(), chi_square_p_value(F.col("statistic"), F.col("freedom")))
        rows.append(found.join(kinds, "column_name").select("column_name", F.lit("chi_square").alias("test"), "statistic", "freedom", p.alias("p_value")))
    return reduce(DataFrame.unionByName, rows).withColumn("is_drifted", F.col("p_value") < alpha)
