"""The composed reports, one entry per card."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.operators import risk as R
from scorewright.operators.actions import recommend_actions
from scorewright.plans import reports as P
from scorewright.presets import Roles
from scorewright.workload.frames import ORDER, RECORDS_CTE, order_records, r6, records, table
from scorewright.workload.relational import (
    BANDED_SQL, FLAGS_SQL, INDICATORS_SQL, MEANS_SQL, SCORECARD_SQL, SUMMARY_SQL, TOP_SQL, TRENDS_SQL, pass_fail_sql_text,
)
from scorewright.workload.stats import OUTLIERS_SQL, histogram_sql

ROLES = Roles(order=["seq"])


def _dashboard(card):
    return lambda spark, d: P.report_dashboard(records(spark, d), ROLES, digits=6)[card]


def dashboard_wide(spark, sf_dir):
    """One row per line, scores in columns."""
    wide = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("student_id"), F.expr("l_quantity * 2.0").alias("maths_marks"),
        F.expr("l_extendedprice / 1049.97").alias("science_marks"),
    )
    return P.report_dashboard(wide, ROLES, measures=["maths_marks", "science_marks"], digits=6)["subjects"]


def _eda(card):
    return lambda spark, d: P.report_eda(records(spark, d), ROLES, digits=6)[card]


def eda_outliers(spark, sf_dir):
    found = P.report_eda(records(spark, sf_dir), ROLES)["outliers"]
    return found.select("student_id", "student_name", "department", F.round("current_gpa", 6).alias("current_gpa"))


def eda_points(spark, sf_dir):
    points = P.report_eda(records(spark, sf_dir), ROLES)["scatter_plots"]
    return points.withColumn("current_gpa", F.round("current_gpa", 6))


def _warning(spark, sf_dir):
    """Predictions by balance for every customer, over the flat records."""
    scores = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("student_id"), F.expr("abs(c_acctbal) / 10000.0").alias("probability"),
        F.expr("c_acctbal / 100.0").alias("attendance"),
    )
    predictions = R.risk_bands(scores, "student_id", digits=6)
    actions = recommend_actions(scores.join(predictions.select("student_id", "risk_level"), "student_id"), "student_id")
    return P.report_early_warning(predictions, records(spark, sf_dir), actions, ROLES, digits=6)


def _warning_card(card):
    return lambda spark, d: _warning(spark, d)[card]


def warning_actions(spark, sf_dir):
    return _warning(spark, sf_dir)["actions"].groupBy("category", "status").agg(F.count(F.lit(1)).alias("rows"))


def _orders_applied(spark, sf_dir):
    return P.apply_model(order_records(spark, sf_dir), R.LOGISTIC, ROLES)


QUERIES = {
    "report_dashboard_summary": _dashboard("summary"),
    "report_dashboard_subjects": _dashboard("subjects"),
    "report_dashboard_subjects_wide": dashboard_wide,
    "report_dashboard_departments": _dashboard("departments"),
    "report_dashboard_top_students": _dashboard("top_students"),
    "report_dashboard_attendance_vs_gpa": _dashboard("attendance_vs_gpa"),
    "report_dashboard_trends": _dashboard("trends"),
    "report_eda_distributions": _eda("distributions"),
    "report_eda_department_analysis": _eda("department_analysis"),
    "report_eda_scatter_plots": eda_points,
    "report_eda_outliers": eda_outliers,
    "report_correlations": lambda spark, d: P.report_correlations(records(spark, d), ROLES),
    "report_early_warning_risk_list": _warning_card("risk_list"),
    "report_early_warning_indicators": _warning_card("indicators"),
    "report_early_warning_actions": warning_actions,
    "report_early_warning_levels": _warning_card("levels"),
    "apply_model_predictions": lambda spark, d: _orders_applied(spark, d)["predictions"],
    "apply_model_actions": lambda spark, d: _orders_applied(spark, d)["actions"],
}

_KEY = ", ".join(ORDER)
_PREDICTIONS = (
    f"predictions as (select c_custkey as student_id, {r6('abs(c_acctbal) / 10000.0 * 100')} as risk_probability, "
    "case when abs(c_acctbal) / 10000.0 >= 0.7 then 'HIGH' when abs(c_acctbal) / 10000.0 >= 0.4 then 'MEDIUM' else 'LOW' end "
    "as risk_level, c_acctbal / 100.0 as attendance from customer)"
)
_WIDE_RATE = "100.0 * count_if({c} >= 40) / cast(count(*) as double)"


def _wide(column: str, name: str, shown: str) -> str:
    rate = _WIDE_RATE.format(c=column)
    return (
        f"select substr(upper('{name}'), 1, 10) as subject_id, '{shown}' as subject_name, 'All' as department, count(*) as total_students, "
        f"cast(count_if({column} >= 40) as bigint) as passed_students, {r6(rate)} as pass_rate, {r6('100.0 - ' + r6(rate))} as fail_rate, "
        f"{r6(f'avg({column})')} as avg_score, {r6(f'avg({column})')} as avg_final_exam from lineitem"
    )


ORACLES = {
    "report_dashboard_summary": f"with {RECORDS_CTE} {SUMMARY_SQL.format(n='total_students')}",
    "report_dashboard_subjects": f"with {RECORDS_CTE} {pass_fail_sql_text('records')}",
    "report_dashboard_subjects_wide": _wide("l_quantity * 2.0", "maths_marks", "Maths Marks") + " union all "
    + _wide("l_extendedprice / 1049.97", "science_marks", "Science Marks"),
    "report_dashboard_departments": f"with {RECORDS_CTE} {SCORECARD_SQL}",
    "report_dashboard_top_students": f"with {RECORDS_CTE} {TOP_SQL}",
    "report_dashboard_attendance_vs_gpa": f"with {RECORDS_CTE} {BANDED_SQL}",
    "report_dashboard_trends": f"with {RECORDS_CTE} {TRENDS_SQL}",
    "report_eda_distributions": f"with {RECORDS_CTE}, " + histogram_sql({"current_gpa": "current_gpa", "attendance": "attendance"}, "records"),
    "report_eda_department_analysis": f"with {RECORDS_CTE} {MEANS_SQL}",
    "report_eda_scatter_plots": f"with {RECORDS_CTE} select student_id, student_name, department, study_hours, attendance as attendance_pct, "
    "round(current_gpa, 6) as current_gpa, lms_activity from records where department is not null and attendance is not null and current_gpa is not null",
    "report_eda_outliers": f"with {RECORDS_CTE}, {OUTLIERS_SQL.format(v='current_gpa', t='records')} select student_id, student_name, department, "
    "round(current_gpa, 6) as current_gpa from records where current_gpa < (select low from fences) or current_gpa > (select high from fences)",
    "report_early_warning_risk_list": f"with {RECORDS_CTE}, {_PREDICTIONS}, f as (select student_id, student_name, department, semester from records "
    f"qualify row_number() over (partition by student_id order by {_KEY}) = 1) select p.student_id, risk_probability, risk_level, "
    "coalesce(student_name, cast(p.student_id as varchar)) as student_name, coalesce(department, 'All') as department, coalesce(semester, 1) as semester "
    "from predictions p left join f on p.student_id = f.student_id",
    "report_early_warning_indicators": f"with {RECORDS_CTE}, indicators as ({INDICATORS_SQL}) {FLAGS_SQL}",
    "report_early_warning_actions": f"with {_PREDICTIONS} select category, 'PENDING' as status, count(*) as rows from ("
    "select 'Attendance Support' as category from predictions where attendance < 65 "
    "union all select 'Attendance Warning' from predictions where attendance >= 65 and attendance < 75 "
    "union all select 'Academic Enrichment' from predictions where attendance >= 75 and risk_level = 'LOW') group by category",
    "report_early_warning_levels": f"with {_PREDICTIONS} select cast(count_if(risk_level = 'HIGH') as bigint) as high_count, "
    "cast(count_if(risk_level = 'MEDIUM') as bigint) as medium_count, cast(count_if(risk_level = 'LOW') as bigint) as low_count from predictions",
}
