"""Rule-based recommendations per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions.text import one_decimal

# Bounds, categories and wording of each rule, in order.
ATTENDANCE_CRITICAL, ATTENDANCE_WARNING = 65.0, 75.0
COMPLETION_LOW, EXAM_LOW = 50.0, 40.0
ATTENDANCE_SUPPORT = ("Attendance Support", "Critical: Attendance is low at %s%%. Recommend academic counseling.")
ATTENDANCE_NOTICE = ("Attendance Warning", "Warning: Attendance is at %s%%. Remind student of attendance limits.")
ASSIGNMENT_HELP = ("Assignment Assistance", "Critical: Assignment completion is only %s%%. Peer tutoring recommended.")
EXAM_HELP = ("Exam Remediation", "Exam alert: Student exam average is low (%s%%). Remediation program suggested.")
MENTORSHIP = ("Mentorship Program",
              "Declining trend: Performance has declined. Recommend placement in faculty mentorship.")
URGENT = ("Personalized Intervention",
          "High-Risk Profile: Multiple negative indicators. Urgent counselor meeting recommended.")
ENRICHMENT = ("Academic Enrichment",
              "Excellent: Stable performance. Recommend for honors track or peer tutoring role.")


def _action(rule: tuple[str, str], value: Column | None = None) -> Column:
    category, wording = rule
    text = F.lit(wording) if value is None else F.format_string(wording, one_decimal(value))
    return F.struct(F.lit(category).alias("category"), text.alias("recommendation_text"))


def recommend_actions(
    df: DataFrame,
    entity: str,
    *,
    attendance: str | None = "attendance",
    completion: str | None = "assignment_completion",
    exam: str | None = "final_exam",
    trend: str | None = "performance_trend",
    level: str = "risk_level",
) -> DataFrame:
    """0 to 5 rows per entity, all PENDING, with a stable ``id``.

    Absent columns raise no action. A HIGH entity with two or more hits gets an
    urgent one on top; a LOW entity without any gets the enrichment offer.
    """

    def col(name: str | None) -> Column | None:
        return F.col(name) if name and name in df.columns else None

    hits = []
    if (a := col(attendance)) is not None:
        hits.append(
            F.when(a < ATTENDANCE_CRITICAL, _action(ATTENDANCE_SUPPORT, a))
            .when(a < ATTENDANCE_WARNING, _action(ATTENDANCE_NOTICE, a))
        )
    if (c := col(completion)) is not None:
        hits.append(F.when(c < COMPLETION_LOW, _action(ASSIGNMENT_HELP, c)))
    if (e := col(exam)) is not None:
        hits.append(F.when(e < EXAM_LOW, _action(EXAM_HELP, e)))
    if (t := col(trend)) is not None:
        hits.append(F.when(t == "DECLINING", _action(MENTORSHIP)))
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<struct<category:string,recommendation_text:string>>")

    listed = df.select(F.col(entity), F.col(level).alias("_level"), found.alias("_hits"))
    extra = (
        F.when((F.col("_level") == "HIGH") & (F.size("_hits") >= 2), F.array(_action(URGENT)))
        .when((F.col("_level") == "LOW") & (F.size("_hits") == 0), F.array(_action(ENRICHMENT)))
        .otherwise(F.slice(F.array(_action(URGENT)), 1, 0))
    )
    rows = listed.select(entity, F.inline(F.concat("_hits", extra)))
    return rows.select(
        F.md5(F.concat_ws("|", F.col(entity).cast("string"), "category")).alias("id"),
        entity,
        "category",
        "recommendation_text",
        F.lit("PENDING").alias("status"),
    )
