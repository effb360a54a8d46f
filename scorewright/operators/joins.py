"""Joins. Broadcast or shuffle is the planner's choice from known sizes.

Adaptive execution splits a shuffled partition that one key makes too large;
where a grouping on the same key follows, rows are counted before they join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.operators.ordering import first_per_key


def join_inner(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    return left.join(right, on, "inner")


def join_composite(base: DataFrame, first: DataFrame, second: DataFrame, key: str, item: str) -> DataFrame:
    """Three tables: ``base`` by ``key``, the two keyed by (``key``, ``item``).

    The two wide tables are joined on their full key first, which no single
    key can skew, then matched with ``base``.
    """
    return base.join(first.join(second, [key, item]), key)


def join_lookup_default(
    rows: DataFrame, details: DataFrame, key: str, defaults: dict[str, Column], order: list[str]
) -> DataFrame:
    """Attach the first detail row per key; unmatched or null values take ``defaults``.

    ``details`` is reduced to one row per key before the join.
    """
    wanted = details.select(key, *[c for c in defaults if c in details.columns], *order)
    first = first_per_key(wanted, [key], order).select(key, *[c for c in defaults if c in details.columns])
    joined = rows.join(first, key, "left")
    return joined.withColumns({
        c: F.coalesce(F.col(c), default) if c in details.columns else default for c, default in defaults.items()
    })


def map_labels(df: DataFrame, column: str, labels: dict, alias: str) -> DataFrame:
    """Translate a column by a small fixed dictionary; unknown values give null."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return df.withColumn(alias, F.try_element_at(F.create_map(*pairs), F.col(column)))


def join_anti_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")
