"""Data-quality report on a raw frame.

Equal rows are collapsed first (partial aggregation keeps a heavily repeated
row from travelling more than once per task), and every figure is a weighted
sum over the collapsed rows: one scan and one shuffle for the whole report.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from scorewright.functions.numbers import outside, parse_number
from scorewright.presets import ACADEMIC_RANGES, MeasureRule
from scorewright.sources.naming import check_mapping

_N = "_copies"

# Fixed values: (upper bound of GOOD, upper bound of WARNING), both exclusive.
MISSING_LIMITS = (2.0, 5.0)
DUPLICATE_LIMITS = (1, 10)
MARKS_LIMITS = (1, 5)
ATTENDANCE_LIMITS = (1, 5)
GRADES = ("GOOD", "WARNING", "CRITICAL")


def collapse_rows(df: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies; nulls are equal to nulls."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias(_N))


def _missing(df: DataFrame, column: str) -> Column:
    value = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def _count(flag: Column, weight: Column | None = None) -> Column:
    weight = F.lit(1) if weight is None else weight
    return F.coalesce(F.sum(F.when(flag, weight).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


def dq_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.lit(len(df.columns)).cast("bigint").alias("total_columns"))


def dq_duplicates(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row; blank rows count like any other."""
    return collapse_rows(df).agg(F.coalesce(F.sum(F.col(_N) - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def dq_missing(df: DataFrame) -> DataFrame:
    nulls = reduce(lambda a, b: a + b, [_count(_missing(df, c)) for c in df.columns])
    cells = F.count(F.lit(1)) * len(df.columns)
    return df.agg(
        nulls.alias("missing_count"),
        F.coalesce(F.try_divide(nulls.cast("double"), cells.cast("double")) * 100.0, F.lit(0.0)).alias(
            "missing_percentage"
        ),
    )


def dq_missing_by_column(df: DataFrame) -> DataFrame:
    counted = df.agg(*[_count(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_count"))
        for i, c in enumerate(df.columns)
    ])))


def dq_empty_columns(df: DataFrame) -> DataFrame:
    empty = [F.when(_count(~_missing(df, c)) == 0, 1).otherwise(0) for c in df.columns]
    return df.agg(reduce(lambda a, b: a + b, empty).cast("bigint").alias("empty_columns"))


def _violations(df: DataFrame, rules: list[MeasureRule], weight: Column | None = None) -> Column:
    parts = [
        _count(outside(parse_number(F.col(f"`{r.column}`"), df.schema[r.column].dataType), r.low, r.high), weight)
        for r in rules
        if r.column in df.columns
    ]
    return reduce(lambda a, b: a + b, parts, F.lit(0).cast("bigint"))


def dq_range_violations(df: DataFrame, rules: list[MeasureRule]) -> DataFrame:
    """One row per rule: values below its low or above its high bound; texts are ignored."""
    used = [r for r in rules if r.column in df.columns]
    counted = df.agg(*[_violations(df, [r]).alias(f"v{i}") for i, r in enumerate(used)])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(r.column).alias("column_name"), F.lit(float(r.low)).alias("low"),
                 F.lit(float(r.high)).alias("high"), F.col(f"v{i}").alias("violations"))
        for i, r in enumerate(used)
    ])))


def grade(figure: Column, limits: tuple[float, float]) -> Column:
    good, warning = limits
    return F.when(figure < good, GRADES[0]).when(figure < warning, GRADES[1]).otherwise(GRADES[2])


def worst(*grades: Column) -> Column:
    severity = [F.array_position(F.array(*[F.lit(g) for g in GRADES]), g) for g in grades]
    return F.get(F.array(*[F.lit(g) for g in GRADES]), (F.greatest(*severity) - 1).cast("int"))


def dq_status(report: DataFrame) -> DataFrame:
    """Grades of the four figures of a report row."""
    return report.withColumns({
        "missing_status": grade(F.col("missing_percentage"), MISSING_LIMITS),
        "duplicates_status": grade(F.col("duplicates"), DUPLICATE_LIMITS),
        "marks_status": grade(F.col("invalid_marks"), MARKS_LIMITS),
        "attendance_status": grade(F.col("invalid_attendance"), ATTENDANCE_LIMITS),
    })


def dq_overall(graded: DataFrame) -> DataFrame:
    """The worst of the four grades."""
    statuses = [F.col(f"{name}_status") for name in ("missing", "duplicates", "marks", "attendance")]
    return graded.withColumn("overall_status", worst(*statuses))


def quality_report(
    df: DataFrame, ranges: dict[str, list[MeasureRule]] = ACADEMIC_RANGES, mapping: dict[str, str] | None = None
) -> DataFrame:
    """All figures and grades in one row.

    ``ranges`` holds the rules counted as invalid marks and invalid attendance,
    naming columns of ``df``, or fields that ``mapping`` has the columns of.
    """
    if mapping:
        used = check_mapping(df.columns, mapping)
        ranges = {name: [replace(r, column=used.get(r.column, r.column)) for r in rules] for name, rules in ranges.items()}
    rows = collapse_rows(df)
    copies = F.col(_N)
    total = F.coalesce(F.sum(copies), F.lit(0)).cast("bigint")
    nulls = reduce(lambda a, b: a + b, [_count(_missing(df, c), copies) for c in df.columns])
    empty = [F.when(_count(~_missing(df, c)) == 0, 1).otherwise(0) for c in df.columns]
    figures = rows.agg(
        total.alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.coalesce(F.sum(copies - 1), F.lit(0)).cast("bigint").alias("duplicates"),
        nulls.alias("missing_count"),
        _violations(df, ranges.get("marks", []), copies).alias("invalid_marks"),
        _violations(df, ranges.get("attendance", []), copies).alias("invalid_attendance"),
        reduce(lambda a, b: a + b, empty).cast("bigint").alias("empty_columns"),
    )
    cells = (F.col("total_rows") * F.col("total_columns")).cast("double")
    figures = figures.withColumn(
        "missing_percentage",
        F.coalesce(F.try_divide(F.col("missing_count").cast("double"), cells) * 100.0, F.lit(0.0)),
    )
    return dq_overall(dq_status(figures))
