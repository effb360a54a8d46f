"""Order statistics, ranks and top-k that never sort one big group in one task.

Exact medians, tie-averaged ranks and running totals all need "how much lies
below this value in its group". Rows are first collapsed to (group, value,
count) and range partitioned by group and value; only the totals of each
(group, partition) are accumulated in order, and each partition is then ordered
on its own. A group holding a third of all rows is spread over as many tasks as
its rows need. There is one way for all sizes: a small table has one partition.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorewright.operators.selection import wide_quantiles
from scorewright.session import materialise

ROWS_PER_BUCKET = 1_000_000

_BUCKET, _LOWER = "_bucket", "_lower"


def _ranged(table: DataFrame, order: list[Column], rows_per_bucket: int) -> DataFrame:
    """The table range partitioned by ``order`` and stored with its partition's number.

    Stored, so that a repeated task cannot move a row to another partition.
    """
    parts = max(1, math.ceil(table.count() / rows_per_bucket))  # rows from file footers
    return materialise(table.repartitionByRange(parts, *order).withColumn(_BUCKET, F.spark_partition_id()), "ranged")


def running_counts(
    counted: DataFrame,
    value: str,
    weights: list[str],
    by: list[str] = (),
    *,
    descending: bool = False,
    tie_order: list[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """For each row, the weight before it in its group and the group's total.

    ``counted`` must be a materialised table without nulls in ``by``; rows are ordered by ``value`` then
    ``tie_order``. Adds ``<w>_before`` and ``<w>_total`` per weight.
    """
    by = list(by)
    direction = F.desc if descending else F.asc
    inside_order = [direction(value), *[F.asc(c) for c in tie_order]]
    bucketed = _ranged(counted, [*[F.asc(c) for c in by], *inside_order], rows_per_bucket)
    totals = bucket_totals(bucketed, weights, by)
    inside = Window.partitionBy(*by, _BUCKET).orderBy(*inside_order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.join(totals, [*by, _BUCKET])
        .select(
            *counted.columns,
            *[
                (F.col(f"{w}{_LOWER}") + F.coalesce(F.sum(w).over(inside), F.lit(0))).alias(f"{w}_before")
                for w in weights
            ],
            *[F.col(f"{w}_total") for w in weights],
        )
    )


def bucket_totals(bucketed: DataFrame, weights: list[str], by: list[str]) -> DataFrame:
    """Per (group, bucket): its weight, the weight in earlier buckets, the group's total.

    At most one row per group and partition reaches the ordered window.
    """
    earlier = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    sums = bucketed.groupBy(*by, _BUCKET).agg(*[F.sum(w).alias(f"{w}_in") for w in weights])
    return sums.select(
        *by,
        _BUCKET,
        *[F.col(f"{w}_in") for w in weights],
        *[F.coalesce(F.sum(f"{w}_in").over(earlier), F.lit(0)).alias(f"{w}{_LOWER}") for w in weights],
        *[F.sum(f"{w}_in").over(group).alias(f"{w}_total") for w in weights],
    )


def value_counts(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Collapse to (by, value, n), dropping rows with a null in any of them."""
    keys = [*by, value]
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])
    return df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: list[float],
    by: list[str] = (),
    *,
    counted: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Linearly interpolated quantiles ``q0, q1, ...`` and count ``n`` per group.

    With ``counted`` the input already is a materialised (by, value, n) table.
    Only the one or two buckets of a group that hold a wanted rank are ordered.
    """
    by = list(by)
    table = df if counted else materialise(value_counts(df, value, by), "counts")

    def rank(p: float, bound) -> Column:
        return bound((F.col("n_total") - 1) * F.lit(float(p)))

    def holds_rank(first: Column, last: Column) -> Column:
        return reduce(
            lambda a, b: a | b, [(first <= rank(p, F.ceil)) & (last >= rank(p, F.floor)) for p in probabilities]
        )

    bucketed = _ranged(table, [F.asc(c) for c in [*by, value]], rows_per_bucket)
    lower = F.col(f"n{_LOWER}")
    totals = bucket_totals(bucketed, ["n"], by).where(holds_rank(lower, lower + F.col("n_in") - 1))
    inside = Window.partitionBy(*by, _BUCKET).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = bucketed.join(totals, [*by, _BUCKET]).withColumn(
        "_from", lower + F.coalesce(F.sum("n").over(inside), F.lit(0))
    )
    ranked = ranked.withColumn("_to", F.col("_from") + F.col("n") - 1).where(holds_rank(F.col("_from"), F.col("_to")))

    def at(p: float, bound) -> Column:
        return F.max(F.when((F.col("_from") <= rank(p, bound)) & (F.col("_to") >= rank(p, bound)), F.col(value)))

    picked = ranked.groupBy(*by).agg(
        F.max("n_total").alias("n_total"),
        *[at(p, F.floor).alias(f"_lo{i}") for i, p in enumerate(probabilities)],
        *[at(p, F.ceil).alias(f"_hi{i}") for i, p in enumerate(probabilities)],
    )
    return picked.select(
        *by,
        F.col("n_total").alias("n"),
        *[
            (
                F.col(f"_lo{i}")
                + (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
                * ((F.col("n_total") - 1) * F.lit(float(p)) - rank(p, F.floor))
            ).alias(f"q{i}")
            for i, p in enumerate(probabilities)
        ],
    )


def group_median(
    df: DataFrame, value: str, by: list[str] = (), *, exact: bool = True, alias: str = "median"
) -> DataFrame:
    """Median of ``value`` per group; ``exact=False`` trades it for a bounded sketch."""
    by = list(by)
    keys_present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by], F.lit(True))
    if exact:
        found = wide_quantiles(df.where(keys_present), [value], by=by)
        return found.where("n0 > 0").select(*by, F.col("q0").alias(alias))
    return df.where(keys_present).groupBy(*by).agg(F.percentile_approx(value, 0.5).cast("double").alias(alias))


def average_ranks(
    counted: DataFrame,
    value: str,
    by: list[str] = (),
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Tie-averaged rank of each value of a materialised (by, value, n) table."""
    ranked = running_counts(counted, value, ["n"], by, rows_per_bucket=rows_per_bucket)
    return ranked.withColumn("rank", F.col("n_before") + (F.col("n") + 1) / F.lit(2.0))


def rank_rows(
    df: DataFrame,
    value: str,
    *,
    method: str = "rank",
    alias: str = "rank",
    ties: list[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Rank all rows by ``value`` descending, in the column's own order; nulls come last.

    ``method``: ``rank`` (gaps after ties), ``dense_rank`` or ``row_number``
    (ties ordered by ``ties``, then by a hash of the row).
    """
    if method not in ("rank", "dense_rank", "row_number"):
        raise ValueError(f"unknown ranking method {method!r}")
    table = materialise(df, "ranked")
    if method == "row_number":
        ready = materialise(table.withColumns({"_one": F.lit(1), "_tie": F.xxhash64(*table.columns)}), "numbered")
        numbered = running_counts(
            ready, value, ["_one"], descending=True, tie_order=[*ties, "_tie"], rows_per_bucket=rows_per_bucket
        )
        return numbered.select(*table.columns, (F.col("_one_before") + 1).cast("bigint").alias(alias))
    counted = materialise(
        table.groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1)), "counts"
    )
    before = "n_before" if method == "rank" else "_one_before"
    ranks = running_counts(
        counted, "_value", ["n", "_one"], descending=True, rows_per_bucket=rows_per_bucket
    ).select("_value", (F.col(before) + 1).cast("bigint").alias(alias))
    return table.join(ranks, table[value].eqNullSafe(ranks["_value"])).select(*table.columns, alias)


def top_k(df: DataFrame, value: str, k: int = 10, ties: list[str] = (), *, alias: str | None = None) -> DataFrame:
    """The ``k`` rows with the largest ``value``; a distributed top-k, no full sort."""
    best = df.orderBy(F.desc_nulls_last(value), *[F.asc(c) for c in ties]).limit(k)
    if alias is None:
        return best
    order = Window.orderBy(F.desc_nulls_last(value), *[F.asc(c) for c in ties])  # at most k rows
    return best.withColumn(alias, F.row_number().over(order).cast("bigint"))


def dense_rank_top(df: DataFrame, value: str, k: int = 10, *, alias: str = "rank") -> DataFrame:
    """Rows whose dense rank by ``value`` descending is at most ``k``, ties kept whole.

    The k best distinct values are at most k rows, so they are broadcast; the
    rows that tie on them stay where they are.
    """
    best = (
        df.where(F.col(value).isNotNull()).select(value).distinct().orderBy(F.desc(value)).limit(k)
    )
    order = Window.orderBy(F.desc(value))  # at most k rows
    ranks = best.withColumn(alias, F.row_number().over(order).cast("bigint"))
    return df.join(F.broadcast(ranks), value)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in ``order``; partially aggregated before the shuffle."""
    return _pick(df, keys, F.min_by, order)


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key in ``order``."""
    return _pick(df, keys, F.max_by, order)


def _pick(df: DataFrame, keys: list[str], pick, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    chosen = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, "_row.*").select(*df.columns)
