"""Read-only SQL: a free-form query and the ready-made ones over the star tables."""

from __future__ import annotations

from scorewright.plans.sql import canned_queries, explorer_queries, sql_readonly
from scorewright.workload.frames import RECORDS_CTE, STAR_CTE, records, star, table

CANNED = canned_queries(digits=6)
EXPLORER = explorer_queries(digits=6, rate_digits=6, order="l_orderkey, l_partkey, l_suppkey")

FREE_FORM = """
    select department, performance_trend, count(*) as n, min(attendance) as least, max(attendance) as most
    from raw_records where semester >= 3 group by department, performance_trend having count(*) > 1
"""


def _over_star(query):
    return lambda spark, d: sql_readonly(spark, query, star(spark, d))


def _over_records(query):
    return lambda spark, d: sql_readonly(spark, query, {"raw_records": records(spark, d).drop("seq")})


def sql_readonly_sets(spark, sf_dir):
    """Set operations come with free-form SQL."""
    tables = {n: table(spark, sf_dir, n) for n in ("customer", "supplier")}
    return sql_readonly(
        spark, "select c_nationkey as nation from customer intersect select s_nationkey from supplier", tables
    )


QUERIES = {
    "sql_readonly": _over_records(FREE_FORM),
    "sql_readonly_sets": sql_readonly_sets,
    **{f"sql_canned_{i}": _over_star(q) for i, q in enumerate(CANNED.values(), start=1)},
    "sql_canned_ui_1": _over_records(EXPLORER["rows"]),
    **{f"sql_canned_ui_{i}": _over_star(EXPLORER[k]) for i, k in enumerate(list(EXPLORER)[1:], start=2)},
}

_JOINED = ("students s join student_performance p on s.student_id = p.student_id "
           "join attendance a on s.student_id = a.student_id and p.subject_id = a.subject_id")


def _bands(alias: str, labels: list[str]) -> str:
    return (
        f"with {STAR_CTE} select case when attendance_pct >= 90 then '{labels[0]}' when attendance_pct >= 75 then '{labels[1]}' "
        f"when attendance_pct >= 60 then '{labels[2]}' else '{labels[3]}' end as {alias}, round(avg(current_gpa), 6) as avg_gpa, "
        f"count(distinct s.student_id) as student_count from {_JOINED} group by 1 order by avg_gpa desc"
    )


_DEPARTMENTS = (
    "select department, avg(current_gpa) as g, avg(attendance_pct) as t, count(distinct s.student_id) as n "
    f"from {_JOINED} group by department"
)
ORACLES = {
    "sql_readonly": f"with {RECORDS_CTE} {FREE_FORM.replace('raw_records', 'records')}",
    "sql_readonly_sets": "select c_nationkey as nation from customer intersect select s_nationkey from supplier",
    "sql_canned_1": f"with {STAR_CTE} select round(avg(g), 6) as avg_gpa, round(avg(t), 6) as avg_attendance, count(distinct student_id) as total_students "
    f"from (select s.student_id, avg(current_gpa) as g, avg(attendance_pct) as t from {_JOINED} group by s.student_id)",
    "sql_canned_2": f"with {STAR_CTE} select s.subject_id, subject_name, department, count(*) as total_students, "
    "cast(sum(case when performance_index >= 50 then 1 else 0 end) as bigint) as passed_students, "
    "round(cast(sum(case when performance_index >= 50 then 1 else 0 end) as double) / count(*) * 100, 6) as pass_rate, "
    "round((1 - cast(sum(case when performance_index >= 50 then 1 else 0 end) as double) / count(*)) * 100, 6) as fail_rate, "
    "round(avg(performance_index), 6) as avg_score, round(avg(final_exam), 6) as avg_final_exam "
    "from subjects s join student_performance p on s.subject_id = p.subject_id "
    "join assessments e on p.student_id = e.student_id and p.subject_id = e.subject_id group by all",
    "sql_canned_3": f"with {STAR_CTE}, d as ({_DEPARTMENTS}) select department, round(g, 6) as avg_gpa, round(t, 6) as avg_attendance, "
    "n as student_count, cast(rank() over (order by g desc) as integer) as dept_rank from d",
    "sql_canned_4": f"with {STAR_CTE}, e as (select s.student_id, student_name, department, avg(current_gpa) as g, avg(attendance_pct) as t "
    f"from {_JOINED} group by all), r as (select *, dense_rank() over (order by g desc) as rnk from e) "
    "select student_id, student_name, department, round(g, 6) as gpa, round(t, 6) as attendance, cast(rnk as integer) as rnk from r where rnk <= 10",
    "sql_canned_5": _bands("attendance_group", ["90% - 100%", "75% - 89%", "60% - 74%", "Below 60%"]),
    "sql_canned_6": f"with {STAR_CTE} select performance_trend, count(distinct student_id) as count, round(avg(current_gpa), 6) as avg_gpa "
    "from student_performance group by 1",
    "sql_canned_ui_1": f"with {RECORDS_CTE} select * from records order by l_orderkey, l_partkey, l_suppkey limit 10",
    "sql_canned_ui_2": f"with {STAR_CTE}, e as (select s.student_id, student_name, department, round(avg(current_gpa), 6) as avg_gpa, "
    f"round(avg(attendance_pct), 6) as avg_attendance from {_JOINED} group by all) "
    "select *, cast(dense_rank() over (order by avg_gpa desc) as integer) as gpa_rank from e order by gpa_rank, student_id limit 10",
    "sql_canned_ui_3": f"with {STAR_CTE}, d as ({_DEPARTMENTS}) select department, round(g, 6) as department_gpa, "
    "round(t, 6) as department_attendance_pct, n as student_count, cast(rank() over (order by g desc) as integer) as dept_rank from d",
    "sql_canned_ui_4": f"with {STAR_CTE} select subject_name, department, count(*) as total_students, "
    "round(cast(count_if(performance_index >= 50) as double) / count(*) * 100, 6) as pass_rate_pct, "
    "round((1 - cast(count_if(performance_index >= 50) as double) / count(*)) * 100, 6) as fail_rate_pct "
    "from subjects s join student_performance p on s.subject_id = p.subject_id group by s.subject_id, subject_name, department",
    "sql_canned_ui_5": _bands("attendance_band", [
        "90% - 100% (Excellent)", "75% - 89% (Good/Required)", "60% - 74% (Shortage/Warning)", "Below 60% (Critical Risk)"
    ]),
}
