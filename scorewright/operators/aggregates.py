"""Filters, grouped summaries and entity roll-ups.

Null group keys are dropped wherever a report groups by them. Entities are
aggregated before they meet another table or a coarser group, so what is
shuffled is one partial row per key and task, however frequent the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions.numbers import percent, round_even
from scorewright.functions.text import contains_ignore_case, display_name, short_label
from scorewright.operators.ordering import rank_rows
from scorewright.presets import ATTENDANCE_BANDS, BAND_DEFAULT, INDICATOR_LIMITS, PASS_MARK


def filter_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def filter_facets(
    df: DataFrame,
    facets: dict[str, str],
    search: str = "",
    search_columns: list[str] = (),
    *,
    wildcard: str = "ALL",
) -> DataFrame:
    """Equality per facet (``ALL`` matches anything) and a text search over some columns."""
    for column, wanted in facets.items():
        if wanted != wildcard:
            df = df.where(F.col(column) == wanted)
    if search and search_columns:
        hits = [F.coalesce(contains_ignore_case(F.col(c), search), F.lit(False)) for c in search_columns]
        df = df.where(reduce(lambda a, b: a | b, hits))
    return df


def facet_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def project_points(df: DataFrame, columns: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """The present ones of ``columns`` without incomplete rows; at least two must be there."""
    present = [c for c in columns if c in df.columns]
    if len(present) < 2:
        raise ValueError("points need at least two of the columns")
    return df.select(*present).na.drop().withColumnsRenamed(rename or {})


def band(value: Column, bands: list[tuple[float, str]] = ATTENDANCE_BANDS, default: str = BAND_DEFAULT) -> Column:
    """Label of the first bound not above ``value``; null falls to the default."""
    label = None
    for bound, name in bands:
        label = F.when(value >= bound, name) if label is None else label.when(value >= bound, name)
    return label.otherwise(default)


def case_bands(df: DataFrame, column: str, alias: str, bands=ATTENDANCE_BANDS, default: str = BAND_DEFAULT) -> DataFrame:
    return df.withColumn(alias, band(F.col(column), bands, default))


def global_summary(df: DataFrame, measures: dict[str, str], entity: str | None, *, digits: int | None = 2) -> DataFrame:
    """Means (alias -> column; 0 when nothing is present) and number of entities (rows if no id)."""
    means = [
        F.coalesce(round_even(F.avg(c), digits), F.lit(0.0)).alias(alias)
        for alias, c in measures.items()
        if c in df.columns
    ]
    entities = F.countDistinct(entity) if entity else F.count(F.lit(1))
    return df.agg(*means, entities.alias("entities"))


def two_level_avg(df: DataFrame, entity: str, measures: dict[str, str], *, digits: int | None = 2) -> DataFrame:
    """Mean over entities of each entity's mean, and the number of entities."""
    per_entity = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        *[F.avg(c).alias(alias) for alias, c in measures.items()]
    )
    return per_entity.agg(
        *[round_even(F.avg(alias), digits).alias(alias) for alias in measures], F.count(F.lit(1)).alias("entities")
    )


def pass_fail_long(
    df: DataFrame,
    item: str,
    score: str | None,
    *,
    exam: str | None = None,
    group: str | None = None,
    order: list[str] = (),
    threshold: float = PASS_MARK,
    digits: int | None = 2,
) -> DataFrame:
    """Per item: rows, passes, rates and means. The rate's base is all rows, nulls too.

    ``group`` adds the group of the item's first row in ``order``.
    """
    none = F.lit(0.0)
    value = F.col(score) if score else F.lit(None).cast("double")
    rows = df.where(F.col(item).isNotNull())
    figures = {
        "total_students": F.count(F.lit(1)),
        "passed_students": F.count_if(value >= threshold),
        "_scored": F.count(value),
        "_sum": F.sum(value),
        "_exams": F.count(exam) if exam else F.lit(0).cast("bigint"),
        "_exam_sum": F.sum(exam) if exam else F.lit(None).cast("double"),
    }
    named = [c.alias(a) for a, c in figures.items()]
    if group and len(order) == 1:
        # one sequence column: collapse to (item, group) with plain counters and a
        # minimum, so that nothing is sorted; the few rows left pick the first group
        pairs = rows.groupBy(item, group).agg(*named, F.min(order[0]).alias("_seen"))
        per_item = pairs.groupBy(item).agg(
            F.min_by(group, "_seen").alias("department"), *[F.sum(a).alias(a) for a in figures]
        )
    else:
        first_group = F.min_by(group, F.struct(*order)) if group else F.lit("All")
        per_item = rows.groupBy(item).agg(first_group.alias("department"), *named)
    mean = F.coalesce(round_even(F.try_divide("_sum", "_scored"), digits), none)
    exam_mean = F.coalesce(round_even(F.try_divide("_exam_sum", "_exams"), digits), mean)
    per_item = per_item.withColumns({"avg_score": mean, "avg_final_exam": exam_mean})
    rate = round_even(percent(F.col("passed_students"), F.col("total_students")), digits)
    rated = F.col("_scored") > 0
    return per_item.select(
        short_label(F.col(item)).alias("subject_id"),
        F.col(item).alias("subject_name"),
        "department",
        "total_students",
        "passed_students",
        F.when(rated, rate).otherwise(none).alias("pass_rate"),
        F.when(rated, round_even(100.0 - rate, digits)).otherwise(none).alias("fail_rate"),
        "avg_score",
        "avg_final_exam",
    )


def pass_fail_wide(
    df: DataFrame, measures: list[str], *, threshold: float = PASS_MARK, digits: int | None = 2
) -> DataFrame:
    """The same per score column; the rate's base is the non-null values. One pass, no shuffle of rows."""
    entries = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in measures]
    long = df.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull())
    per_measure = long.groupBy("measure").agg(
        F.count(F.lit(1)).alias("total_students"),
        F.count_if(F.col("value") >= threshold).alias("passed_students"),
        round_even(F.avg("value"), digits).alias("avg_score"),
    )
    rate = round_even(percent(F.col("passed_students"), F.col("total_students")), digits)
    return per_measure.select(
        short_label(F.col("measure")).alias("subject_id"),
        display_name(F.col("measure")).alias("subject_name"),
        F.lit("All").alias("department"),
        "total_students",
        "passed_students",
        rate.alias("pass_rate"),
        round_even(100.0 - rate, digits).alias("fail_rate"),
        "avg_score",
        F.col("avg_score").alias("avg_final_exam"),
    )


def group_scorecard(
    df: DataFrame,
    group: str,
    entity: str | None,
    *,
    score: str | None = None,
    attendance: str | None = None,
    digits: int | None = 2,
    ranked: bool = True,
) -> DataFrame:
    """Per group: entities, mean score, mean attendance, and position by mean score.

    Positions follow the rounded mean, ties the group's name.
    """
    entities = F.countDistinct(entity) if entity else F.count(F.lit(1))
    columns = [entities.alias("student_count")]
    for alias, c in (("avg_gpa", score), ("avg_attendance", attendance)):
        if c:
            columns.append(F.coalesce(round_even(F.avg(c), digits), F.lit(0.0)).alias(alias))
    card = df.where(F.col(group).isNotNull()).groupBy(group).agg(*columns)
    return position_rank(card, "avg_gpa", [group], alias="dept_rank") if score and ranked else card


def banded_avg(
    df: DataFrame,
    banded: str,
    score: str,
    entity: str | None,
    *,
    bands: list[tuple[float, str]] = ATTENDANCE_BANDS,
    default: str = BAND_DEFAULT,
    alias: str = "attendance_group",
    digits: int | None = 2,
) -> DataFrame:
    """Per band of one column: mean score and entities, in band order."""
    entities = F.countDistinct(entity) if entity else F.count(F.lit(1))
    labels = [name for _, name in bands] + [default]
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(alias))
    return (
        case_bands(df, banded, alias, bands, default)
        .groupBy(alias)
        .agg(F.coalesce(round_even(F.avg(score), digits), F.lit(0.0)).alias("avg_gpa"), entities.alias("student_count"))
        .orderBy(place)
    )


def trend_summary(df: DataFrame, trend: str, score: str | None, entity: str | None, *, digits: int | None = 2) -> DataFrame:
    """Per trend label: entities and mean score."""
    entities = F.countDistinct(entity) if entity else F.count(F.lit(1))
    mean = F.coalesce(round_even(F.avg(score), digits), F.lit(0.0)) if score else F.lit(0.0)
    return df.where(F.col(trend).isNotNull()).groupBy(trend).agg(entities.alias("count"), mean.alias("avg_gpa"))


def group_means(
    df: DataFrame, group: str, measures: list[str], *, rename: dict[str, str] | None = None, digits: int | None = 2
) -> DataFrame:
    """Per group: mean of each measure present."""
    names = rename or {}
    present = [m for m in measures if m in df.columns]
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        *[round_even(F.avg(m), digits).alias(names.get(m, m)) for m in present]
    )


def first_present(column: str, order: list[str]) -> Column:
    """Aggregate: the first non-null value in ``order``."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.struct(*order)))


def entity_rollup(
    df: DataFrame,
    entity: str,
    means: list[str],
    firsts: list[str] = (),
    label: str | None = None,
    *,
    order: list[str] = (),
) -> DataFrame:
    """One row per entity: means of the measures, first non-null attributes, most frequent label.

    Give a single sequence column as ``order`` where there is one: it is the faster way.
    """
    rows = df.where(F.col(entity).isNotNull())
    if firsts and len(order) == 1:
        # one sequence column: attributes hardly vary within an entity, so collapsing
        # to (entity, attributes) first needs only sums, counts and a minimum
        collapsed = rows.groupBy(entity, *firsts).agg(
            *[F.sum(m).alias(f"_sum_{i}") for i, m in enumerate(means)],
            *[F.count(m).alias(f"_n_{i}") for i, m in enumerate(means)],
            F.min(order[0]).alias("_seen"),
        )
        rolled = collapsed.groupBy(entity).agg(
            *[F.try_divide(F.sum(f"_sum_{i}"), F.sum(f"_n_{i}")).alias(m) for i, m in enumerate(means)],
            *[first_present(c, ["_seen"]).alias(c) for c in firsts],
        )
    else:
        rolled = rows.groupBy(entity).agg(
            *[F.avg(m).alias(m) for m in means], *[first_present(c, list(order)).alias(c) for c in firsts]
        )
    return rolled.join(group_mode(rows, entity, label), entity, "left") if label else rolled


def group_mode(df: DataFrame, group: str, label: str) -> DataFrame:
    """Most frequent non-null label per group; of equals, the lowest.

    Labels are counted per (group, label) first, so no group's labels are ever
    gathered in one place.
    """
    counted = (
        df.where(F.col(group).isNotNull() & F.col(label).isNotNull())
        .groupBy(group, label)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    best = F.min(F.struct((-F.col("_n")).alias("_rank"), F.col(label)))
    return counted.groupBy(group).agg(best[label].alias(label))


def entity_indicators(
    df: DataFrame,
    entity: str,
    *,
    attendance: str = "attendance",
    internals: tuple[str, str] = ("internal_1", "internal_2"),
    completion: str = "assignment_completion",
    hours: str = "study_hours",
    previous: str = "previous_gpa",
    digits: int | None = 1,
) -> DataFrame:
    """Per entity: the means a case worker looks at. Absent columns count as 0."""

    def mean(column: str) -> Column:
        return F.avg(column) if column in df.columns else F.lit(0.0)

    return df.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        round_even(mean(attendance), digits).alias("attendance_avg"),
        round_even((mean(internals[0]) + mean(internals[1])) / 2.0, digits).alias("internals_avg"),
        round_even(mean(completion), digits).alias("assign_completion"),
        round_even(mean(hours), digits).alias("study_hours"),
        round_even(mean(previous), digits).alias("previous_gpa"),
    )


def indicator_flags(indicators: DataFrame, limits: dict[str, float] = INDICATOR_LIMITS) -> DataFrame:
    """Adds ``<indicator>_low``: is it below its limit?"""
    return indicators.withColumns({
        f"{c}_low": F.coalesce(F.col(c) < limit, F.lit(False)) for c, limit in limits.items()
    })


def level_counts(df: DataFrame, level: str = "risk_level", levels: tuple[str, ...] = ("HIGH", "MEDIUM", "LOW")) -> DataFrame:
    """Rows per level, in one row; absent levels give 0."""
    return df.agg(*[F.count_if(F.col(level) == x).alias(f"{x.lower()}_count") for x in levels])


def table_counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows per table with its description; each count is read from file footers where possible."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), F.lit(text).alias("description"), "row_count"
        )
        for name, (df, text) in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def rank_groups(df: DataFrame, group: str, score: str, *, extra: dict[str, Column] | None = None, digits: int | None = None) -> DataFrame:
    """Group means with their RANK (gaps after ties), best first."""
    means = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        round_even(F.avg(score), digits).alias("avg_score"), *[c.alias(a) for a, c in (extra or {}).items()]
    )
    return rank_rows(means, "avg_score", method="rank", alias="rank")


def position_rank(df: DataFrame, score: str, ties: list[str], *, alias: str = "position") -> DataFrame:
    """1..n by descending score, equal scores by ``ties``."""
    return rank_rows(df, score, method="row_number", alias=alias, ties=ties)


def group_transform(df: DataFrame, group: str, aggregates: dict[str, Column]) -> DataFrame:
    """Each row with aggregates of its group.

    Aggregate and join instead of a window: partial sums move, and a frequent
    group's rows stay spread out.
    """
    totals = df.where(F.col(group).isNotNull()).groupBy(group).agg(*[c.alias(a) for a, c in aggregates.items()])
    return df.join(totals, group, "left")
