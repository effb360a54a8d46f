"""What the columns hold and which reports they allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from scorewright.functions.numbers import nan_to_null, parse_number
from scorewright.presets import DERIVED_FIELDS, NUMERIC_FIELDS, TEXT_FIELDS


def _present(df: DataFrame, column: str) -> Column:
    value = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        value = nan_to_null(value)
    return F.count(value)


def _numeric(df: DataFrame, column: str) -> Column:
    return F.count(parse_number(F.col(f"`{column}`"), df.schema[column].dataType))


def column_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: rows, values present, values that parse as numbers.

    All columns are counted in a single pass.
    """
    names = columns or df.columns
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[_present(df, c).alias(f"p{i}") for i, c in enumerate(names)],
        *[_numeric(df, c).alias(f"n{i}") for i, c in enumerate(names)],
    )
    return counted.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("rows").alias("n_rows"),
            F.col(f"p{i}").alias("n_present"),
            F.col(f"n{i}").alias("n_numeric"),
        )
        for i, c in enumerate(names)
    ])))


def profile_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``empty``, ``numeric`` or ``text`` per column."""
    present, numeric = F.col("n_present"), F.col("n_numeric")
    kind = F.when(present == 0, "empty").when(present == numeric, "numeric").otherwise("text")
    return column_counts(df, columns).withColumn("detected_type", kind)


def numeric_coercible(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: is it non-empty with every value a number?"""
    coercible = (F.col("n_present") > 0) & (F.col("n_present") == F.col("n_numeric"))
    return column_counts(df, columns).select("column_name", coercible.alias("coercible"))


def coercible_flag(df: DataFrame, column: str) -> Column:
    """Aggregate expression behind :func:`numeric_coercible`."""
    return (_present(df, column) > 0) & (_present(df, column) == _numeric(df, column))


def discover_measures(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    """Columns outside the vocabulary that hold only numbers: the score columns.

    ``exclude`` lists further id or ordinal columns. One aggregate row, one
    flag per column, comes back to the driver.
    """
    known = {*TEXT_FIELDS, *NUMERIC_FIELDS, *DERIVED_FIELDS, *exclude}
    candidates = [c for c in df.columns if c not in known]
    if not candidates:
        return []
    flags = df.agg(*[coercible_flag(df, c).alias(str(i)) for i, c in enumerate(candidates)]).first()
    return [c for i, c in enumerate(candidates) if flags[str(i)]]


def capabilities(df: DataFrame, exclude: list[str] = ("semester",)) -> DataFrame:
    """One row telling which report families the columns allow.

    ``wide_measures`` are the score columns; any of them makes the layout
    ``wide`` (one row per entity) instead of ``long``.
    """
    has = set(df.columns).__contains__
    known = {*TEXT_FIELDS, *NUMERIC_FIELDS, *DERIVED_FIELDS, *exclude}
    candidates = [c for c in df.columns if c not in known]
    flags = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[coercible_flag(df, c).alias(f"_f{i}") for i, c in enumerate(candidates)],
    )
    found = [F.when(F.col(f"_f{i}"), F.lit(c)) for i, c in enumerate(candidates)]
    measures = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    wide = F.size("wide_measures") > 0
    return flags.select(measures.alias("wide_measures")).select(
        F.lit(has("student_name") or has("student_id")).alias("entity_reports"),
        (F.lit(has("subject")) | wide).alias("subject_reports"),
        (F.lit(has("final_exam") or has("performance_index")) | wide).alias("marks_reports"),
        F.lit(has("attendance")).alias("attendance_reports"),
        F.lit(has("previous_gpa") or has("current_gpa")).alias("score_reports"),
        F.lit(has("department")).alias("group_reports"),
        F.lit(has("semester")).alias("term_reports"),
        F.lit(has("study_hours") or has("lms_activity")).alias("behavior_reports"),
        "wide_measures",
        F.when(wide, "wide").otherwise("long").alias("layout"),
    )
