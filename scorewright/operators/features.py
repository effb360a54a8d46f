"""Entity feature tables for segmentation and risk models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scorewright.functions.names import ref
from scorewright.operators.aggregates import entity_rollup
from scorewright.operators.selection import wide_quantiles
from scorewright.session import materialise


def fill_medians(table: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls to the column's median; all columns are selected together.

    ``table`` should be stored: it is read twice.
    """
    found = wide_quantiles(table, columns).first()  # one row
    medians = {c: found[f"q{i}"] for i, c in enumerate(columns) if found[f"q{i}"] is not None}
    return table.withColumns({
        c: F.coalesce(ref(c).cast("double"), F.lit(medians[c])) if c in medians else ref(c).cast("double")
        for c in columns
    })


def feature_matrix(
    records: DataFrame,
    entity: str,
    features: list[str],
    *,
    also: list[str] = (),
    firsts: list[str] = (),
    label: str | None = None,
    order: list[str] = (),
) -> DataFrame:
    """One row per entity: mean of each present feature, nulls as the feature's median.

    ``also`` are further means left as they are; ``firsts`` attributes and
    ``label`` the most frequent value. At least two features must be present.
    """
    present = [c for c in features if c in records.columns]
    if len(present) < 2:
        raise ValueError("at least two of the feature columns are needed")
    extra = [c for c in also if c in records.columns and c not in present]
    attributes = [c for c in firsts if c in records.columns]
    table = materialise(
        entity_rollup(records, entity, [*present, *extra], attributes, label, order=list(order)), "features"
    )
    return fill_medians(table, present)


def minmax_scale(table: DataFrame, columns: list[str]) -> DataFrame:
    """(x - min) / (max - min + 1e-9) per column; a constant column becomes 0."""
    ends = table.agg(F.struct(*[
        F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns
    ])).scalar()
    return table.withColumns({
        c: (F.col(c) - ends[c]["lo"]) / (ends[c]["hi"] - ends[c]["lo"] + F.lit(1e-9)) for c in columns
    })
