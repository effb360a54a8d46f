"""Cleaning and feature derivation, one step per function, and all in order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions.names import ref
from scorewright.functions.numbers import clip, mean_of_present, outside, parse_number, round_even
from scorewright.functions.text import clean_text, strip, title_case
from scorewright.operators.profile import discover_measures
from scorewright.operators.quality import _N as COPIES, collapse_rows
from scorewright.operators.selection import wide_quantiles
from scorewright.presets import (
    ACADEMIC_RULES,
    INDEX_WEIGHTS,
    NUMERIC_FIELDS,
    TEXT_FIELDS,
    TREND_MARGIN,
    MeasureRule,
    score_rule,
)
from scorewright.session import materialise
from scorewright.sources.naming import check_mapping, rename_mapped


def drop_blank_rows(df: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Drop rows whose every column (but ``ignore``) is null."""
    return df.na.drop("all", subset=[f"`{c}`" for c in df.columns if c not in ignore])


def dedup_rows(df: DataFrame, order: str | None = None) -> DataFrame:
    """Distinct rows. ``order`` is a row number left out of the comparison; the least is kept."""
    if order is None:
        return df.distinct()
    rest = [c for c in df.columns if c != order]
    return df.groupBy(*[ref(c) for c in rest]).agg(F.min(ref(order)).alias(order)).select(*[ref(c) for c in df.columns])


def clean_text_columns(df: DataFrame, columns: list[str] = TEXT_FIELDS, title: list[str] = ("subject",)) -> DataFrame:
    """Strip, null the missing-value tokens, and title-case the ``title`` columns."""
    used = {c: clean_text(ref(c)) for c in columns if c in df.columns}
    used.update({c: title_case(used.get(c, ref(c))) for c in title if c in df.columns})
    return df.withColumns(used) if used else df


def coerce_numeric(df: DataFrame, columns: list[str] = NUMERIC_FIELDS) -> DataFrame:
    """Parse to double; what is no number becomes null."""
    used = {c: parse_number(ref(c), df.schema[c].dataType) for c in columns if c in df.columns}
    return df.withColumns(used) if used else df


def clip_range(df: DataFrame, rules: list[MeasureRule] = ACADEMIC_RULES) -> DataFrame:
    used = {r.column: clip(ref(r.column), r.low, r.high) for r in rules if r.column in df.columns}
    return df.withColumns(used) if used else df


def impute_group_median(df: DataFrame, rules: list[MeasureRule], group: str | None = None) -> DataFrame:
    """Fill nulls with the group's median, else the overall median, else the rule's fallback.

    All measures are selected together (``selection``); a null group uses the overall median. ``df`` is read
    several times, so pass a stored table when its plan is costly.
    """
    used = [r for r in rules if r.column in df.columns]
    if not used:
        return df
    columns = [r.column for r in used]
    overall = wide_quantiles(df, columns).first()  # one row
    fills = [F.lit(float(r.fallback if overall[f"q{i}"] is None else overall[f"q{i}"])) for i, r in enumerate(used)]
    if not group:
        return df.withColumns({r.column: F.coalesce(ref(r.column), fill) for r, fill in zip(used, fills)})
    medians = wide_quantiles(df, columns, by=[group]).select(
        ref(group).alias("_group"), *[F.col(f"q{i}").alias(f"_median_{i}") for i in range(len(used))])
    joined = df.join(medians, ref(group) == F.col("_group"), "left")
    return joined.withColumns({
        r.column: F.coalesce(ref(r.column), F.col(f"_median_{i}"), fill) for i, (r, fill) in enumerate(zip(used, fills))
    }).select(*[ref(c) for c in df.columns])


@dataclass(frozen=True)
class IndexPart:
    """One weighted part of the index: sum of its columns as a percentage of ``out_of``."""

    name: str
    columns: tuple[str, ...]
    out_of: float = 100.0

    def present_in(self, df: DataFrame) -> bool:
        return any(c in df.columns for c in self.columns)

    def value(self, df: DataFrame) -> Column:
        present = [ref(c) for c in self.columns if c in df.columns]
        total = reduce(lambda a, b: a + b, present)
        return total if self.out_of == 100.0 else total / F.lit(self.out_of) * 100.0


# The parts and the full marks of the two internals together.
INDEX_PARTS = (
    IndexPart("internal", ("internal_1", "internal_2"), 60.0),
    IndexPart("assignment", ("assignment_score",)),
    IndexPart("quiz", ("quiz_score",)),
    IndexPart("final_exam", ("final_exam",)),
)


def weighted_index(
    df: DataFrame,
    weights: dict[str, float] | None = None,
    parts: tuple[IndexPart, ...] = INDEX_PARTS,
    *,
    alias: str = "performance_index",
    digits: int | None = 2,
) -> DataFrame:
    """Weighted mean of the parts present, weights rescaled to sum to one.

    The internal part divides by its full marks even if one of its two columns
    is absent.
    """
    given = weights or INDEX_WEIGHTS
    active = {p: given.get(p.name, INDEX_WEIGHTS.get(p.name, 0.0)) for p in parts if p.present_in(df)}
    total = sum(active.values())
    terms = [p.value(df) * F.lit(w / total) for p, w in active.items()] if total > 0 else [F.lit(0.0)]
    return df.withColumn(alias, round_even(reduce(lambda a, b: a + b, terms), digits))


def row_mean_index(
    df: DataFrame, measures: list[str], *, alias: str = "performance_index", digits: int | None = 2
) -> DataFrame:
    """Mean of the row's score columns, nulls skipped."""
    return df.withColumn(alias, round_even(mean_of_present([ref(c) for c in measures]), digits))


def scale_score(df: DataFrame, index: str = "performance_index", alias: str = "current_gpa", digits: int | None = 2):
    """The 0-100 index as a 0-10 score."""
    return df.withColumn(alias, round_even(F.col(index) / 10.0, digits))


def score_change(
    df: DataFrame,
    current: str = "current_gpa",
    previous: str = "previous_gpa",
    *,
    alias: str = "performance_change",
    digits: int | None = 2,
) -> DataFrame:
    """Current minus previous score; 0 when there is no previous column."""
    change = round_even(F.col(current) - F.col(previous), digits) if previous in df.columns else F.lit(0.0)
    return df.withColumn(alias, change)


def trend_label(
    df: DataFrame, change: str = "performance_change", *, alias: str = "performance_trend", margin: float = TREND_MARGIN
) -> DataFrame:
    label = (
        F.when(F.col(change) > margin, "IMPROVING").when(F.col(change) < -margin, "DECLINING").otherwise("STABLE")
    )
    return df.withColumn(alias, label)


def cleaning_audit_by_column(
    df: DataFrame, mapping: dict[str, str], rules: list[MeasureRule] = ACADEMIC_RULES
) -> DataFrame:
    """Per measure: texts turned null, nulls to fill, values out of range (after dedup)."""
    rows = rename_mapped(drop_blank_rows(df), mapping).distinct()
    used = [r for r in rules if r.column in rows.columns]
    parsed = {r: parse_number(ref(r.column), rows.schema[r.column].dataType) for r in used}

    def count(flag: Column) -> Column:
        return F.count_if(flag)

    counted = rows.agg(*[
        F.struct(
            F.lit(r.column).alias("column_name"),
            count(value.isNull() & ref(r.column).isNotNull()).alias("coerced"),
            count(value.isNull()).alias("filled"),
            count(outside(value, r.low, r.high)).alias("corrected"),
        ).alias(f"_{i}")
        for i, (r, value) in enumerate(parsed.items())
    ])
    return counted.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(used))])))


def cleaning_audit(
    df: DataFrame,
    mapping: dict[str, str],
    rules: list[MeasureRule] = ACADEMIC_RULES,
    text_columns: list[str] = TEXT_FIELDS,
    measures: list[str] = (),
) -> DataFrame:
    """What cleaning ``df`` changes, in one row and one shuffle.

    ``measures`` are the discovered score columns, audited by the same range as
    cleaning gives them (``discover_measures`` of the mapped frame finds them).

    A text that is no number counts twice in ``missing_filled``: once when it
    becomes null and once when that null is filled.
    """
    rows = rename_mapped(collapse_rows(drop_blank_rows(df)), mapping)
    used = [r for r in [*rules, *[score_rule(c) for c in measures]] if r.column in rows.columns]
    parsed = {r: parse_number(ref(r.column), rows.schema[r.column].dataType) for r in used}
    zero = F.lit(0).cast("bigint")

    def total(parts: list[Column]) -> Column:
        return F.coalesce(F.sum(reduce(lambda a, b: a + b, parts, zero)), zero)

    def one_if(flag: Column) -> Column:
        return F.when(flag, 1).otherwise(0).cast("bigint")

    filled = [one_if(v.isNull()) for v in parsed.values()] + [
        one_if(v.isNull() & ref(r.column).isNotNull()) for r, v in parsed.items()
    ]
    padded = [
        F.coalesce(strip(ref(c)) != ref(c).cast("string"), F.lit(False)) for c in text_columns if c in rows.columns
    ]
    return rows.agg(
        F.coalesce(F.sum(F.col(COPIES) - 1), zero).alias("duplicates_removed"),
        total(filled).alias("missing_filled"),
        total([one_if(outside(v, r.low, r.high)) for r, v in parsed.items() if r.family == "marks"]).alias(
            "marks_corrected"
        ),
        total([one_if(outside(v, r.low, r.high)) for r, v in parsed.items() if r.family != "marks"]).alias(
            "attendance_corrected"
        ),
        F.count_if(reduce(lambda a, b: a | b, padded, F.lit(False))).alias("trimmed_records"),
    )


def clean_records(
    df: DataFrame,
    mapping: dict[str, str],
    *,
    rules: list[MeasureRule] = ACADEMIC_RULES,
    weights: dict[str, float] | None = None,
    group: str = "subject",
    measures: list[str] | None = None,
    exclude: list[str] = ("semester",),
    digits: int | None = 2,
) -> DataFrame:
    """Raw frame to scored records: every cleaning step in its fixed order.

    ``measures`` names the extra score columns; by default every unmapped
    column holding only numbers is one, but for those in ``exclude``. The
    deduplicated, clipped rows are stored once, since medians need them twice.
    """
    check_mapping(df.columns, mapping)
    rows = rename_mapped(dedup_rows(drop_blank_rows(df)), mapping)
    if measures is None:
        measures = discover_measures(rename_mapped(df, mapping), exclude)
    all_rules = [*rules, *[score_rule(c) for c in measures]]
    rows = clean_text_columns(rows)
    rows = clip_range(coerce_numeric(rows, [*NUMERIC_FIELDS, *measures]), all_rules)
    rows = impute_group_median(materialise(rows, "clipped"), all_rules, group if group in rows.columns else None)

    if "final_exam" in rows.columns or "internal_1" in rows.columns:
        rows = weighted_index(rows, weights, digits=digits)
    elif measures:
        rows = row_mean_index(rows, measures, digits=digits)
    else:
        return rows
    return trend_label(score_change(scale_score(rows, digits=digits), digits=digits))
