"""The dashboard, the exploratory report, and the early-warning report.

Each takes flat records and returns a dict of DataFrames, one per card; a card
whose columns are absent is left out. Nothing runs until a card is used, but
for the few one-row lookups the operators need. Pass stored records: each card
reads only the columns it shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scorewright.functions.numbers import round_even
from scorewright.operators import aggregates as A
from scorewright.operators.ordering import top_k
from scorewright.operators.features import feature_matrix
from scorewright.operators.joins import join_lookup_default
from scorewright.operators.actions import recommend_actions
from scorewright.operators.risk import FOREST, LABEL, PROBABILITY, risk_bands, risk_label, score_all
from scorewright.operators.statistics import correlation_tests, histogram, iqr_outliers
from scorewright.presets import (
    CORRELATION_TESTS,
    GROUP_MEASURES,
    OUTLIER_COLUMNS,
    PASS_MARK,
    POINT_COLUMNS,
    RISK_FEATURES,
    Roles,
)


def report_dashboard(
    records: DataFrame,
    roles: Roles = Roles(),
    *,
    threshold: float = PASS_MARK,
    measures: list[str] | None = None,
    digits: int | None = 2,
) -> dict[str, DataFrame]:
    """Cards: summary, subjects, departments, top_students, attendance_vs_gpa, trends.

    Give ``measures`` (score columns) for records with one row per entity.
    """
    has = set(records.columns).__contains__
    entity = roles.entity_in(records.columns)
    score = roles.score if has(roles.score) else None
    attendance = roles.attendance if has(roles.attendance) else None
    cards = {
        "summary": A.global_summary(
            records, {"avg_gpa": roles.score, "avg_attendance": roles.attendance}, entity, digits=digits
        ).withColumnRenamed("entities", "total_students")
    }
    if measures:
        cards["subjects"] = A.pass_fail_wide(records, measures, threshold=threshold, digits=digits)
    elif has(roles.item):
        marks = roles.index if has(roles.index) else (roles.exam if has(roles.exam) else None)
        cards["subjects"] = A.pass_fail_long(
            records, roles.item, marks, exam=roles.exam if has(roles.exam) else None,
            group=roles.group if has(roles.group) else None, order=roles.order or records.columns,
            threshold=threshold, digits=digits,
        )
    if has(roles.group):
        cards["departments"] = A.group_scorecard(
            records, roles.group, entity, score=score, attendance=attendance, digits=digits
        )
    if score and entity:
        cards["top_students"] = top_entities(records, roles, entity, attendance, digits=digits)
    if score and attendance:
        cards["attendance_vs_gpa"] = A.banded_avg(records, attendance, score, entity, digits=digits)
    if has(roles.trend):
        cards["trends"] = A.trend_summary(records, roles.trend, score, entity, digits=digits)
    return cards


def top_entities(
    records: DataFrame, roles: Roles, entity: str, attendance: str | None, k: int = 10, *, digits: int | None = 2
) -> DataFrame:
    """The k best entities by mean score, with name, group and mean attendance."""
    firsts = [c for c in (roles.group, roles.name) if c in records.columns and c != entity]
    means = [roles.score, *([attendance] if attendance else [])]
    rolled = A.entity_rollup(records, entity, means, firsts, order=roles.order or records.columns)
    best = top_k(rolled, roles.score, k, [entity], alias="rnk")
    shown_id = F.col(entity).cast("string")
    shown_name = F.coalesce(F.col(roles.name), shown_id) if roles.name in firsts else shown_id
    return best.select(
        shown_id.alias("student_id"),
        shown_name.alias("student_name"),
        (F.col(roles.group) if roles.group in firsts else F.lit("All")).alias("department"),
        round_even(F.col(roles.score), digits).alias("gpa"),
        (round_even(F.col(attendance), digits) if attendance else F.lit(0.0)).alias("attendance"),
        "rnk",
    )


def report_eda(records: DataFrame, roles: Roles = Roles(), *, digits: int | None = 2) -> dict[str, DataFrame]:
    """Cards: distributions, department_analysis, scatter_plots, outliers."""
    has = set(records.columns).__contains__
    rename = {roles.attendance: "attendance_pct"}
    cards = {}
    measured = [c for c in (roles.score, roles.attendance) if has(c)]
    if measured:
        cards["distributions"] = histogram(records, measured, digits=digits)
    if has(roles.group) and any(has(m) for m in GROUP_MEASURES):
        cards["department_analysis"] = A.group_means(records, roles.group, GROUP_MEASURES, rename=rename, digits=digits)
    if sum(map(has, POINT_COLUMNS)) >= 2:
        cards["scatter_plots"] = A.project_points(records, POINT_COLUMNS, rename)
    if has(roles.score):
        cards["outliers"] = iqr_outliers(records, roles.score, [c for c in OUTLIER_COLUMNS if has(c)])
    return cards


def report_correlations(records: DataFrame, roles: Roles = Roles(), *, digits: int | None = 3) -> DataFrame:
    """One row per tested variable; raises without a score column."""
    if roles.score not in records.columns:
        raise ValueError(f"correlations need the score column {roles.score!r}")
    return correlation_tests(records, roles.score, CORRELATION_TESTS, digits=digits)


def apply_model(
    records: DataFrame, model_name: str = FOREST, roles: Roles = Roles(), *, digits: int | None = 2
) -> dict[str, DataFrame]:
    """Score every entity and derive levels and actions: ``predictions`` and ``actions``.

    The model is fitted on the rows it scores. Levels use fixed bounds; a
    user's risk threshold plays no part in them.
    """
    entity = roles.entity_in(records.columns)
    table = feature_matrix(
        records, entity, RISK_FEATURES, also=[roles.score, roles.exam, "previous_gpa", roles.attendance],
        label=roles.trend if roles.trend in records.columns else None, order=roles.order or records.columns,
    )
    features = [c for c in RISK_FEATURES if c in records.columns]
    scored = score_all(risk_label(table), features, model_name, LABEL, entity=entity)
    predictions = risk_bands(scored, entity, PROBABILITY, digits=digits)
    return {
        "predictions": predictions,
        "actions": recommend_actions(scored.join(predictions.select(entity, "risk_level"), entity), entity),
    }


def report_early_warning(
    predictions: DataFrame, records: DataFrame | None, actions: DataFrame, roles: Roles = Roles(),
    *, digits: int | None = 1,
) -> dict[str, DataFrame]:
    """Cards: risk_list (riskiest first), indicators with flags, actions, levels."""
    if records is None:
        risk = predictions.withColumns({
            "student_name": F.col(roles.entity).cast("string"), "department": F.lit("All"), "semester": F.lit(1),
        })
        cards = {}
    else:
        entity = roles.entity_in(records.columns)
        defaults = {
            "student_name": F.col(roles.entity).cast("string"), roles.group: F.lit("All"), "semester": F.lit(1),
        }
        details = records if entity == roles.entity else records.withColumnRenamed(entity, roles.entity)
        risk = join_lookup_default(predictions, details, roles.entity, defaults, roles.order or details.columns)
        cards = {"indicators": A.indicator_flags(A.entity_indicators(records, entity, digits=digits))}
    cards["risk_list"] = risk.orderBy(F.desc("risk_probability"), roles.entity)
    cards["actions"] = actions
    cards["levels"] = A.level_counts(predictions)
    return cards


def entity_panel(cards: dict[str, DataFrame], entity_value, roles: Roles = Roles()) -> dict[str, DataFrame]:
    """The rows of one entity on each card."""
    return {
        name: card.where(F.col(roles.entity) == F.lit(entity_value))
        for name, card in cards.items()
        if roles.entity in card.columns
    }
