"""Histograms, outliers, correlations with significance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from scorewright.functions.numbers import round_even
from scorewright.operators.ordering import average_ranks
from scorewright.operators.selection import wide_quantiles
from scorewright.presets import CORRELATION_TESTS
from scorewright.session import materialise

# Fence factor, least rows, significance level, strength bounds and labels.
FENCE = 1.5
MIN_ROWS_OUTLIERS, MIN_ROWS_CORRELATION = 4, 5
ALPHA = 0.05
STRONG, MODERATE = 0.6, 0.3
STRENGTHS = ("Strong positive linear correlation", "Moderate positive correlation", "Weak correlation",
             "No statistically significant correlation")
SUMMARY_FORMAT = (
    "Null Hypothesis (H0): There is no correlation between %s and student GPA.\n"
    "Alternative Hypothesis (Ha): There is a statistically significant correlation.\n"
    "Decision: %s (p-value = %.2e)."
)
DECISIONS = ("Reject H0", "Fail to Reject H0")


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    entries = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull())


def histogram(df: DataFrame, columns: list[str], bins: int = 10, *, digits: int | None = 2) -> DataFrame:
    """Counts in equal bins between min and max per column; the last bin is closed.

    One row per (measure, bin), empty bins included. A constant column is
    widened by half a unit to each side.
    """
    long = _long(df, columns)
    ends = long.groupBy("measure").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    half = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    ends = ends.select("measure", (F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi"))

    value, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    step = (hi - lo) / F.lit(bins)

    def edge(i: Column) -> Column:
        return F.when(i == bins, hi).otherwise(i * step + lo)

    guess = F.least(F.floor((value - lo) * (F.lit(float(bins)) / (hi - lo))), F.lit(bins - 1))
    # the product may be one bin off next to an edge: the edges decide
    placed = (
        F.when(value < edge(F.col("_i")), F.col("_i") - 1)
        .when((value >= edge(F.col("_i") + 1)) & (F.col("_i") < bins - 1), F.col("_i") + 1)
        .otherwise(F.col("_i"))
    )
    counts = (
        long.join(F.broadcast(ends), "measure")  # one row per column
        .withColumn("_i", guess)
        .groupBy("measure", placed.alias("bin"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    return grid.join(counts, ["measure", "bin"], "left").select(
        "measure",
        (F.col("bin") + 1).alias("bin"),
        round_even(edge(F.col("bin")), digits).alias("bin_from"),
        round_even(edge(F.col("bin") + 1), digits).alias("bin_to"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("count"),
    )


def iqr_outliers(df: DataFrame, value: str, columns: list[str] | None = None) -> DataFrame:
    """Rows below Q1 - 1.5 IQR or above Q3 + 1.5 IQR; none if fewer than four values.

    The two fences are plain numbers by the time rows are read, so the filter
    reaches the file scan. The values are stored on their own, so that the passes
    over them do not repeat the plan behind ``df``.
    """
    picked = df.select(*columns) if columns else df
    values = materialise(df.select(F.col(value).cast("double").alias("value")), "values")
    quartiles = wide_quantiles(values, ["value"], [0.25, 0.75]).first()  # one row
    if quartiles["n0"] < MIN_ROWS_OUTLIERS:
        return picked.where(F.lit(False))
    spread = quartiles["q1"] - quartiles["q0"]
    low, high = quartiles["q0"] - FENCE * spread, quartiles["q1"] + FENCE * spread
    rows = df.where((F.col(value) < low) | (F.col(value) > high))
    return rows.select(*columns) if columns else rows


def _t_statistic(r: Column, n: Column) -> Column:
    return F.when(F.abs(r) >= 1.0, F.lit(float("inf"))).otherwise(
        F.abs(r) * F.sqrt((n - 2) / (1.0 - r * r))
    )


def correlate_pearson(df: DataFrame, variables: list[str], target: str) -> DataFrame:
    """variable, n, pearson_coef and |t| for each variable against ``target``.

    All variables share one aggregation. A variable with fewer than five
    complete pairs, or a constant side, gives no row.
    """
    y = F.col(target).cast("double")
    cells = []
    for v in variables:
        x = F.col(v).cast("double")
        both = x.isNotNull() & y.isNotNull()
        spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
        r = F.try_divide(F.covar_pop(x, y), spread)
        cells.append(F.struct(
            F.lit(v).alias("variable"),
            F.count_if(both).alias("n"),
            F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("pearson_coef"),
            spread.alias("_spread"),
        ))
    rows = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    kept = rows.where((F.col("n") >= MIN_ROWS_CORRELATION) & (F.col("_spread") > 0))
    return kept.drop("_spread").withColumn("pearson_t", _t_statistic(F.col("pearson_coef"), F.col("n")))


def correlate_spearman(df: DataFrame, variables: list[str], target: str) -> DataFrame:
    """variable, n, spearman_coef and |t|: Pearson on tie-averaged ranks.

    Equal rows are collapsed to counts before they are laid out as pairs, so a
    row moves once, not once per variable; ranks come from value counts, and
    ranks join pairs on the value: no row is ever numbered globally.
    """
    wide = df.select(F.col(target).cast("double").alias("y"), *[F.col(v).cast("double").alias(f"_x{i}") for i, v in enumerate(variables)])
    counted = wide.where(F.col("y").isNotNull()).groupBy(*wide.columns).agg(F.count(F.lit(1)).alias("n"))
    entries = [
        F.struct(F.lit(v).alias("variable"), F.col(f"_x{i}").alias("x"), F.col("y").alias("y"), F.col("n").alias("n"))
        for i, v in enumerate(variables)
    ]
    pairs = materialise(counted.select(F.inline(F.array(*entries))).where(F.col("x").isNotNull()), "pairs")

    def ranks(side: str) -> DataFrame:
        counted = materialise(pairs.groupBy("variable", side).agg(F.sum("n").alias("n")), "ranks")
        ranked = average_ranks(counted, side, ["variable"])
        # centred on the mean rank, which keeps the sums small
        centred = F.col("rank") - (F.col("n_total") + 1) / F.lit(2.0)
        return ranked.select("variable", side, centred.alias(f"r{side}"))

    joined = pairs.join(ranks("x"), ["variable", "x"]).join(ranks("y"), ["variable", "y"])
    n, rx, ry = F.col("n"), F.col("rx"), F.col("ry")
    sums = joined.groupBy("variable").agg(
        F.sum(n).alias("n"),
        F.sum(n * rx * ry).alias("sxy"),
        F.sum(n * rx * rx).alias("sxx"),
        F.sum(n * ry * ry).alias("syy"),
    )
    spread = F.sqrt("sxx") * F.sqrt("syy")
    return (
        sums.where((F.col("n") >= MIN_ROWS_CORRELATION) & (spread > 0))
        .select("variable", "n", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sxy") / spread)).alias("spearman_coef"))
        .withColumn("spearman_t", _t_statistic(F.col("spearman_coef"), F.col("n")))
    )


def _gamma_step(a: np.ndarray) -> np.ndarray:
    """ln gamma(a + 1/2) - ln gamma(a): the asymptotic series 40 steps up, and back by the recurrence."""
    steps = np.arange(40)
    back = np.log1p(0.5 / (a[:, None] + steps)).sum(axis=1)
    x = a + len(steps)
    series = 0.5 * np.log(x) - 1 / (8 * x) + 1 / (192 * x**3) - 1 / (640 * x**5) + 17 / (14336 * x**7)
    return series - back


# nodes and weights of tanh-sinh quadrature on (0, 1), by the distance from the lower end
_STEP = np.arange(-4.6, 3.2, 1 / 64)
_DISTANCE = 1 / (1 + np.exp(-np.pi * np.sinh(_STEP)))
_WEIGHT = np.pi / 64 * np.cosh(_STEP) * _DISTANCE * (1 - _DISTANCE)


def two_sided_p(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(|T| >= t) of Student's t, by one formula for all degrees of freedom.

    With t = sqrt(dof) tan(u) the tail is the integral of cos(u)^(dof - 1) up to
    a right angle, over half the beta function. The integrand is taken relative
    to its value at the lower end and the range is cut where it has vanished.
    """
    t, dof = np.abs(np.asarray(t, float)), np.asarray(dof, float)
    known = np.isfinite(t) & (dof >= 1)
    out = np.where(np.isinf(t) & (dof >= 1), 0.0, np.nan)
    t, dof = t[known], dof[known]
    low = np.arctan2(t, np.sqrt(dof))
    # beyond this length the integrand has fallen by exp(-60): it falls at least like exp(-k (tan(low) x + x^2 / 2))
    k, slope = dof - 1, t / np.sqrt(dof)
    with np.errstate(divide="ignore"):
        length = np.minimum(np.pi / 2 - low, 120 / (k * slope + np.sqrt((k * slope) ** 2 + 120 * k)))
    x = length[:, None] * _DISTANCE
    # cos(low + x) / cos(low) = cos(x) - tan(low) sin(x)
    fall = np.log1p(np.maximum(-2 * np.sin(x / 2) ** 2 - slope[:, None] * np.sin(x), -1 + 1e-16))
    area = (np.exp(k[:, None] * fall) * _WEIGHT).sum(axis=1) * length
    front = np.exp(-0.5 * k * np.log1p(slope**2) + _gamma_step(dof / 2))
    out[known] = np.minimum(1.0, 2 / np.sqrt(np.pi) * front * area)
    return out


@F.pandas_udf(T.DoubleType())
def t_test_p(t: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of |t| with n - 2 degrees of freedom; runs on result rows only."""
    return pd.Series(two_sided_p(t.to_numpy(), n.to_numpy() - 2.0), dtype="float64")


def classify_correlation(df: DataFrame, r: str = "pearson_coef", p: str = "pearson_p_value") -> DataFrame:
    """Adds significance, strength and the worded decision.

    A negative coefficient, however strong, is at most weak.
    """
    significant = F.col(p) < ALPHA
    strength = (
        F.when(significant & (F.col(r) > STRONG), STRENGTHS[0])
        .when(significant & (F.col(r) > MODERATE), STRENGTHS[1])
        .when(significant, STRENGTHS[2])
        .otherwise(STRENGTHS[3])
    )
    decision = F.when(significant, DECISIONS[0]).otherwise(DECISIONS[1])
    spoken = F.replace(F.col("variable"), F.lit("_"), F.lit(" "))
    return df.withColumns({
        "significant": significant,
        "interpretation": strength,
        "hypothesis_summary": F.format_string(SUMMARY_FORMAT, spoken, decision, F.col(p)),
    })


def correlation_tests(
    df: DataFrame, target: str, tests: list[tuple[str, str]] = CORRELATION_TESTS, *, digits: int | None = 3
) -> DataFrame:
    """One row per tested variable: both coefficients, both p-values, the verdict."""
    labels = {v: label for v, label in tests if v in df.columns}
    pearson = correlate_pearson(df, list(labels), target)
    spearman = correlate_spearman(df, list(labels), target).drop("n")
    tested = pearson.join(spearman, "variable").withColumns({
        "pearson_p_value": t_test_p("pearson_t", "n"),
        "spearman_p_value": t_test_p("spearman_t", "n"),
    })
    classified = classify_correlation(tested)
    label = F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), F.col("variable"))
    return classified.select(
        F.when(F.col("variable") == "attendance", "attendance_pct").otherwise(F.col("variable")).alias("variable"),
        label.alias("label"),
        "n",
        round_even(F.col("pearson_coef"), digits).alias("pearson_coef"),
        "pearson_p_value",
        round_even(F.col("spearman_coef"), digits).alias("spearman_coef"),
        "spearman_p_value",
        "significant",
        "interpretation",
        "hypothesis_summary",
    )
