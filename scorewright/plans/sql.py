"""Read-only SQL over named tables, and the ready-made queries."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Refused as whole words anywhere in the text, in any case.
FORBIDDEN_WORDS = ["insert", "update", "delete", "drop", "alter", "truncate", "create", "replace"]

# Spark runs further commands that change state, so a query must also begin
# like one, and may not call into the JVM by reflection.
_OPENING = re.compile(r"^[\s(]*(select|with|values)\b", re.IGNORECASE)
_COMMENT = re.compile(r"/\*.*?\*/|--[^\n]*", re.DOTALL)
_RELATION = re.compile(r"UnresolvedRelation \[([^\]]*)\]")
_REFLECTION = re.compile(r"\b(reflect|java_method|try_reflect)\s*\(", re.IGNORECASE)


def check_read_only(query: str) -> None:
    """Raise ValueError unless ``query`` only reads."""
    for word in FORBIDDEN_WORDS:
        if re.search(rf"\b{word}\b", query, re.IGNORECASE):
            raise ValueError(f"query refused: it contains the word {word!r}")
    if not _OPENING.match(_COMMENT.sub(" ", query)):
        raise ValueError("query refused: it must start with SELECT, WITH or VALUES")
    if _REFLECTION.search(query):
        raise ValueError("query refused: reflection functions are not allowed")


def check_relations(spark: SparkSession, query: str) -> None:
    """Raise ValueError if ``query`` reads a file: its relations must be plain names, or names in a database."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(query).toString()
    if "UnresolvedIdentifier" in parsed:
        raise ValueError("query refused: relations may not be named by expressions")
    for relation in _RELATION.findall(parsed):
        parts = [p.strip() for p in relation.split(",")]
        if len(parts) > 1 and not spark.catalog.databaseExists(parts[-2]):
            raise ValueError(f"query refused: {'.'.join(parts)} is not a table")


_MADE_HERE = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef"}  # leaves that read nothing stored


def _leaves(plan, known: set[str]):
    """Names of the leaves of an analysed plan that lie under none of the ``known`` views, subqueries included."""
    if plan.nodeName() == "SubqueryAlias" and plan.alias() in known:
        return
    if plan.nodeName().startswith("View"):  # another view of the session
        yield "View"
        return
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    below += [plan.subqueries().apply(i) for i in range(plan.subqueries().size())]
    if not plan.children().size():
        yield plan.nodeName()
    for node in below:
        yield from _leaves(node, known)


def sql_readonly(spark: SparkSession, query: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Check ``query`` and plan it over ``tables`` alone; the caller's views are neither seen nor changed.

    The tables stand in front of the query as common table expressions over views of unguessable names, which are
    dropped once the query is analysed; then every leaf of the analysed plan must lie in one of them. Without
    ``tables`` the query runs over the session's own tables and views.
    """
    check_read_only(query)
    check_relations(spark, query)
    if tables is None:
        return spark.sql(query)
    views = {name: f"_{uuid.uuid4().hex}" for name in tables}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(views[name])
        heads = ", ".join(f"`{name}` as (select * from `{view}`)" for name, view in views.items())
        body = query.strip().rstrip(";")
        planned = spark.sql(f"with {heads} select * from (\n{body}\n)" if heads else body)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    foreign = sorted(set(_leaves(planned._jdf.queryExecution().analyzed(), set(views.values()))) - _MADE_HERE)
    if foreign:
        raise ValueError(f"query refused: it reads more than the given tables ({', '.join(foreign)})")
    return planned


def _facts(*columns: str) -> str:
    """Both fact tables side by side, one row per (student, subject)."""
    return (
        f"select {', '.join(columns)} from student_performance sp "
        "join attendance a using (student_id, subject_id)"
    )


def canned_queries(digits: int = 2, pass_mark: float = 50.0) -> dict[str, str]:
    """The six analytical queries over the star tables.

    Facts are summed per student before students are joined: a student with
    very many rows then joins as one row, and counting students is counting
    rows. Divisions are in double precision.
    """
    per_student = (
        "select student_id, avg(current_gpa) as gpa, avg(attendance_pct) as att, "
        "sum(current_gpa) as gpa_sum, count(current_gpa) as gpa_n, "
        "sum(attendance_pct) as att_sum, count(attendance_pct) as att_n "
        f"from ({_facts('student_id', 'sp.current_gpa', 'a.attendance_pct')}) group by student_id"
    )
    return {
        "summary": f"""
            with per_student as ({per_student})
            select round(avg(gpa), {digits}) as avg_gpa,
                   round(avg(att), {digits}) as avg_attendance,
                   count(*) as total_students
            from per_student join students using (student_id)
        """,
        "subjects": f"""
            with marks as (
                select subject_id,
                       count(*) as total_students,
                       count_if(sp.performance_index >= {pass_mark}) as passed_students,
                       avg(sp.performance_index) as score,
                       avg(e.final_exam) as exam
                from student_performance sp join assessments e using (student_id, subject_id)
                group by subject_id
            )
            select subject_id, subject_name, department, total_students, passed_students,
                   round(cast(passed_students as double) / total_students * 100, {digits}) as pass_rate,
                   round((1 - cast(passed_students as double) / total_students) * 100, {digits}) as fail_rate,
                   round(score, {digits}) as avg_score,
                   round(exam, {digits}) as avg_final_exam
            from marks join subjects using (subject_id)
            order by pass_rate, subject_id
        """,
        "departments": f"""
            with per_student as ({per_student}),
            per_department as (
                select department,
                       sum(gpa_sum) / sum(gpa_n) as gpa,
                       sum(att_sum) / sum(att_n) as att,
                       count(*) as student_count
                from per_student join students using (student_id)
                group by department
            )
            select department,
                   round(gpa, {digits}) as avg_gpa,
                   round(att, {digits}) as avg_attendance,
                   student_count,
                   rank() over (order by gpa desc) as dept_rank
            from per_department
        """,
        "top_students": f"""
            with per_student as ({per_student}),
            placed as (
                select student_id, gpa, att, dense_rank() over (order by gpa desc) as rnk from per_student
            )
            select student_id, student_name, department,
                   round(gpa, {digits}) as gpa, round(att, {digits}) as attendance, rnk
            from placed join students using (student_id)
            where rnk <= 10
            order by rnk, student_id
        """,
        "attendance_bands": _band_query(
            "attendance_group",
            [(90, "90% - 100%"), (75, "75% - 89%"), (60, "60% - 74%")], "Below 60%", digits,
        ),
        "trends": f"""
            select performance_trend,
                   count(distinct student_id) as `count`,
                   round(avg(current_gpa), {digits}) as avg_gpa
            from student_performance
            group by performance_trend
        """,
    }


def _band_query(alias: str, bands: list[tuple[int, str]], rest: str, digits: int) -> str:
    arms = " ".join(f"when attendance_pct >= {low} then '{label}'" for low, label in bands)
    return f"""
        with banded as (
            select student_id, current_gpa, case {arms} else '{rest}' end as {alias}
            from ({_facts('student_id', 'sp.current_gpa', 'a.attendance_pct')})
        ),
        per_student as (
            select {alias}, student_id, sum(current_gpa) as gpa_sum, count(current_gpa) as gpa_n
            from banded group by {alias}, student_id
        )
        select {alias}, round(sum(gpa_sum) / sum(gpa_n), {digits}) as avg_gpa, count(*) as student_count
        from per_student join students using (student_id)
        group by {alias}
        order by avg_gpa desc
    """


def explorer_queries(
    digits: int = 2, rate_digits: int = 1, pass_mark: float = 50.0, rows: int = 10, order: str = "student_id"
) -> dict[str, str]:
    """The five queries of the table explorer: rows, top ten, ranking, rates, bands."""
    return {
        "rows": f"select * from raw_records order by {order} limit {rows}",
        "top_students": f"""
            with means as (
                select student_id, round(avg(current_gpa), {digits}) as avg_gpa,
                       round(avg(attendance_pct), {rate_digits}) as avg_attendance
                from ({_facts('student_id', 'sp.current_gpa', 'a.attendance_pct')})
                group by student_id
            ),
            leaders as (select * from means order by avg_gpa desc, student_id limit {rows})
            select student_id, student_name, department, avg_gpa, avg_attendance,
                   dense_rank() over (order by avg_gpa desc) as gpa_rank
            from leaders join students using (student_id)
            order by gpa_rank, student_id
        """,
        "departments": f"""
            select department, avg_gpa as department_gpa,
                   round(avg_attendance, {rate_digits}) as department_attendance_pct,
                   student_count, dept_rank
            from ({canned_queries(max(digits, rate_digits), pass_mark)['departments']})
            order by dept_rank, department
        """,
        "courses": f"""
            with marks as (
                select subject_id, count(*) as total_students,
                       count_if(performance_index >= {pass_mark}) as passed
                from student_performance group by subject_id
            )
            select subject_name, department, total_students,
                   round(cast(passed as double) / total_students * 100, {rate_digits}) as pass_rate_pct,
                   round((1 - cast(passed as double) / total_students) * 100, {rate_digits}) as fail_rate_pct
            from marks join subjects using (subject_id)
            order by pass_rate_pct, subject_id
        """,
        "attendance_bands": _band_query(
            "attendance_band",
            [(90, "90% - 100% (Excellent)"), (75, "75% - 89% (Good/Required)"),
             (60, "60% - 74% (Shortage/Warning)")],
            "Below 60% (Critical Risk)", digits,
        ),
    }
