"""Filters, joins, aggregates, windows, ordering and distinct."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from scorewright.functions.numbers import round_even
from scorewright.operators import aggregates as A
from scorewright.operators import joins as J
from scorewright.operators import ordering as O
from scorewright.operators.star import distinct_dims
from scorewright.presets import Roles
from scorewright.workload.frames import (
    MEASURES_CTE, ORDER, RECORDS_CTE, STAR_CTE, measures, r6, records, star, table,
)

ROLES = Roles(order=["seq"])
KEY = ", ".join(ORDER)


def _risk(spark, sf_dir):
    """One row per customer with a level by balance: a stand-in for stored predictions."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("student_id"), F.col("c_name").alias("student_name"),
        F.col("c_mktsegment").alias("department"),
        F.expr("case when c_acctbal >= 7000 then 'HIGH' when c_acctbal >= 4000 then 'MEDIUM' else 'LOW' end").alias("risk_level"),
    )


def filter_facets(spark, sf_dir):
    return A.filter_facets(
        _risk(spark, sf_dir), {"risk_level": "HIGH", "department": "ALL"}, "R#00000000", ["student_name", "student_id"]
    )


def filter_facets_all(spark, sf_dir):
    return A.filter_facets(_risk(spark, sf_dir), {"risk_level": "ALL", "department": "MACHINERY"}, "7", ["student_id"])


def filter_rank(spark, sf_dir):
    """The ten best-priced lines of each flag group."""
    rows = measures(spark, sf_dir).where("grp is not null and price is not null")
    ranked = rows.withColumn("rnk", F.rank().over(Window.partitionBy("grp").orderBy(F.desc("price"))))
    return ranked.where("rnk <= 10").select("grp", "price", F.col("rnk").cast("bigint").alias("rnk"))


def case_bands(spark, sf_dir):
    banded = A.case_bands(records(spark, sf_dir), "attendance", "attendance_group")
    return banded.groupBy("attendance_group").agg(F.count(F.lit(1)).alias("rows"))


def join_inner(spark, sf_dir):
    s = star(spark, sf_dir)
    return J.join_inner(s["subjects"], s["student_performance"], "subject_id").select(
        "student_id", "subject_id", "subject_name", round_even(F.col("performance_index"), 6).alias("performance_index")
    )


def join_composite(spark, sf_dir):
    s = star(spark, sf_dir)
    joined = J.join_composite(s["students"], s["student_performance"], s["attendance"], "student_id", "subject_id")
    return joined.select(
        "student_id", "subject_id", "student_name", round_even(F.col("current_gpa"), 6).alias("current_gpa"),
        round_even(F.col("attendance_pct"), 6).alias("attendance_pct"),
    )


def join_salted(spark, sf_dir):
    """Lines with the flags table of their return flag, where each flag holds a third of the lines: the flags are counted
    before the join, so one side has a row per flag, and adaptive execution splits the other."""
    lines = table(spark, sf_dir, "lineitem").select(*ORDER, "l_returnflag")
    flags = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("flag_rows"))
    return J.join_inner(lines, flags, "l_returnflag")


def join_lookup_default(spark, sf_dir):
    """Every customer with its first order; customers and columns without one take defaults."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student_id"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("student_id"), F.col("o_orderpriority").alias("department"), "o_orderkey"
    )
    defaults = {"student_name": F.col("student_id").cast("string"), "department": F.lit("All"), "semester": F.lit(1)}
    return J.join_lookup_default(people, orders, "student_id", defaults, ["o_orderkey"])


def map_labels(spark, sf_dir):
    labels = {"F": "Filled", "O": "Open"}
    return J.map_labels(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", labels, "label")


def join_anti_orphans(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal >= 0")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return J.join_anti_orphans(orders, rich, "o_custkey", "c_custkey")


def two_level_avg(spark, sf_dir):
    s = star(spark, sf_dir)
    facts = s["student_performance"].join(s["attendance"], ["student_id", "subject_id"])
    return A.two_level_avg(facts, "student_id", {"avg_gpa": "current_gpa", "avg_attendance": "attendance_pct"}, digits=6)


def pass_fail_long(spark, sf_dir):
    return A.pass_fail_long(
        records(spark, sf_dir), "subject", "performance_index", exam="final_exam", group="department", order=["seq"], digits=6
    )


def pass_fail_wide(spark, sf_dir):
    rows = measures(spark, sf_dir).withColumnsRenamed({"quantity": "quantity_sold", "discount": "line_discount"})
    return A.pass_fail_wide(rows, ["quantity_sold", "line_discount", "tax"], digits=6)


def pass_fail_sql(spark, sf_dir):
    s = star(spark, sf_dir)
    rows = s["student_performance"].join(s["assessments"], ["student_id", "subject_id"]).withColumn(
        "item", F.col("subject_id").cast("string")
    )
    card = A.pass_fail_long(rows, "item", "performance_index", exam="final_exam", threshold=50.0, digits=6)
    return card.select("subject_id", "total_students", "passed_students", "pass_rate", "fail_rate", "avg_score",
                       "avg_final_exam").orderBy("pass_rate", "subject_id")


def group_scorecard(spark, sf_dir):
    return A.group_scorecard(
        records(spark, sf_dir), "department", "student_id", score="current_gpa", attendance="attendance", digits=6
    )


def entity_rollup(spark, sf_dir):
    rows = records(spark, sf_dir)
    rolled = A.entity_rollup(
        rows, "student_id", ["current_gpa", "attendance"], ["student_name", "department"], "performance_trend", order=["seq"]
    )
    return rolled.withColumns({c: round_even(F.col(c), 6) for c in ("current_gpa", "attendance")})


def table_counts(spark, sf_dir):
    texts = {"customer": "entities", "part": "items", "lineitem": "facts", "orders": "links"}
    return A.table_counts({n: (table(spark, sf_dir, n), text) for n, text in texts.items()})


def group_median(spark, sf_dir):
    medians = O.group_median(measures(spark, sf_dir), "price", ["grp"])
    return medians.withColumn("median", round_even(F.col("median"), 6))


def group_median_global(spark, sf_dir):
    medians = O.group_median(measures(spark, sf_dir), "price")
    return medians.withColumn("median", round_even(F.col("median"), 6))


def rank_groups(spark, sf_dir):
    extra = {"entities": F.countDistinct("student_id")}
    return A.rank_groups(records(spark, sf_dir), "department", "current_gpa", extra=extra, digits=6)


def rank_entities(spark, sf_dir):
    """Every customer ranked by mean score."""
    rows = records(spark, sf_dir)
    means = rows.groupBy("student_id").agg(round_even(F.avg("current_gpa"), 6).alias("avg_gpa"))
    return O.rank_rows(means.where("avg_gpa is not null"), "avg_gpa", method="rank", alias="gpa_rank")


def dense_rank_top(spark, sf_dir):
    """Customers within the ten best distinct (whole-number) mean attendances; ties stay."""
    means = records(spark, sf_dir).groupBy("student_id").agg(F.rint(F.avg("attendance")).alias("attendance"))
    return O.dense_rank_top(means, "attendance", 10, alias="rnk")


def position_rank(spark, sf_dir):
    means = records(spark, sf_dir).groupBy("subject").agg(round_even(F.avg("attendance"), 6).alias("avg_attendance"))
    return A.position_rank(means, "avg_attendance", ["subject"])


def group_transform(spark, sf_dir):
    rows = measures(spark, sf_dir).select(*ORDER, "grp", "quantity")
    return A.group_transform(rows, "grp", {
        "group_mean": round_even(F.avg("quantity"), 6), "group_rows": F.count(F.lit(1))
    })


def average_ranks(spark, sf_dir):
    from scorewright.session import materialise

    counted = materialise(O.value_counts(measures(spark, sf_dir), "price", ["grp"]), "counts")
    return O.average_ranks(counted, "price", ["grp"]).select("grp", "price", "rank")


def top_k_entities(spark, sf_dir):
    from scorewright.plans.reports import top_entities

    return top_entities(records(spark, sf_dir), ROLES, "student_id", "attendance", digits=6)


def order_results(spark, sf_dir):
    return _risk(spark, sf_dir).groupBy("department", "risk_level").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "department", "risk_level"
    )


def limit_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*ORDER, "l_quantity").orderBy(*ORDER).limit(5)


def distinct_on_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return O.first_per_key(orders, ["o_custkey"], ["o_orderkey"])


QUERIES = {
    "filter_present": lambda spark, d: A.filter_present(measures(spark, d), ["quantity", "price"]).select(*ORDER, "quantity", "price"),
    "filter_facets": filter_facets,
    "filter_facets_all": filter_facets_all,
    "facet_values": lambda spark, d: A.facet_values(records(spark, d), "department"),
    "project_points": lambda spark, d: A.project_points(
        records(spark, d), ["student_id", "study_hours", "attendance", "lms_activity", "absent"], {"attendance": "attendance_pct"}
    ),
    "filter_rank": filter_rank,
    "case_bands": case_bands,
    "join_inner": join_inner,
    "join_composite": join_composite,
    "join_salted": join_salted,
    "join_lookup_default": join_lookup_default,
    "map_labels": map_labels,
    "join_anti_orphans": join_anti_orphans,
    "global_summary": lambda spark, d: A.global_summary(
        records(spark, d), {"avg_gpa": "current_gpa", "avg_attendance": "attendance"}, "student_id", digits=6
    ),
    "two_level_avg": two_level_avg,
    "pass_fail_long": pass_fail_long,
    "pass_fail_wide": pass_fail_wide,
    "pass_fail_sql": pass_fail_sql,
    "group_scorecard": group_scorecard,
    "banded_avg": lambda spark, d: A.banded_avg(records(spark, d), "attendance", "current_gpa", "student_id", digits=6),
    "trend_summary": lambda spark, d: A.trend_summary(
        records(spark, d), "performance_trend", "current_gpa", "student_id", digits=6
    ),
    "group_means": lambda spark, d: A.group_means(
        records(spark, d), "department", ["current_gpa", "attendance", "study_hours", "lms_activity", "absent"],
        rename={"attendance": "attendance_pct"}, digits=6,
    ),
    "entity_rollup": entity_rollup,
    "group_mode": lambda spark, d: A.group_mode(records(spark, d), "student_id", "subject"),
    "entity_indicators": lambda spark, d: A.entity_indicators(records(spark, d), "student_id", digits=6),
    "indicator_flags": lambda spark, d: A.indicator_flags(A.entity_indicators(records(spark, d), "student_id", digits=6)),
    "level_counts": lambda spark, d: A.level_counts(_risk(spark, d)),
    "table_counts": table_counts,
    "group_median": group_median,
    "group_median_global": group_median_global,
    "rank_groups": rank_groups,
    "rank_entities": rank_entities,
    "dense_rank_top": dense_rank_top,
    "position_rank": position_rank,
    "group_transform": group_transform,
    "average_ranks": average_ranks,
    "top_k_entities": top_k_entities,
    "order_results": order_results,
    "limit_rows": limit_rows,
    "distinct_dims": lambda spark, d: distinct_dims(records(spark, d), ["subject", "department"]),
    "distinct_on_key": distinct_on_key,
}

_RISK = """risk as (select cast(c_custkey as varchar) as student_id, c_name as student_name, c_mktsegment as department,
    case when c_acctbal >= 7000 then 'HIGH' when c_acctbal >= 4000 then 'MEDIUM' else 'LOW' end as risk_level from customer)"""
BAND_SQL = ("case when attendance >= 90 then '90% - 100%' when attendance >= 75 then '75% - 89%' "
            "when attendance >= 60 then '60% - 74%' else 'Below 60%' end")
_FIRST = f"order by {KEY}"


def pass_fail_sql_text(source: str, threshold: float = 40.0) -> str:
    rate = f"100.0 * count_if(performance_index >= {threshold}) / cast(count(*) as double)"
    return f"""
        select substr(upper(subject), 1, 10) as subject_id, subject as subject_name,
               first(department {_FIRST}) as department, count(*) as total_students,
               cast(count_if(performance_index >= {threshold}) as bigint) as passed_students,
               case when count(performance_index) > 0 then {r6(rate)} else 0.0::double end as pass_rate,
               case when count(performance_index) > 0 then {r6('100.0 - ' + r6(rate))} else 0.0::double end as fail_rate,
               coalesce({r6('avg(performance_index)')}, 0) as avg_score,
               coalesce({r6('avg(final_exam)')}, coalesce({r6('avg(performance_index)')}, 0)) as avg_final_exam
        from {source} where subject is not null group by subject
    """


def _wide(column: str, name: str, shown: str) -> str:
    rate = f"100.0 * count_if({column} >= 40) / cast(count({column}) as double)"
    return (
        f"select substr(upper('{name}'), 1, 10) as subject_id, '{shown}' as subject_name, 'All' as department, "
        f"count({column}) as total_students, cast(count_if({column} >= 40) as bigint) as passed_students, "
        f"{r6(rate)} as pass_rate, {r6('100.0 - ' + r6(rate))} as fail_rate, "
        f"{r6(f'avg({column})')} as avg_score, {r6(f'avg({column})')} as avg_final_exam from m"
    )


TOP_SQL = f"""
    select cast(student_id as varchar) as student_id, first(student_name {_FIRST}) as student_name,
           first(department {_FIRST}) filter (where department is not null) as department,
           {r6('avg(current_gpa)')} as gpa, {r6('avg(attendance)')} as attendance,
           row_number() over (order by avg(current_gpa) desc nulls last, records.student_id) as rnk
    from records group by records.student_id order by rnk limit 10
"""
INDICATORS_SQL = f"""
    select student_id, {r6('avg(attendance)')} as attendance_avg, {r6('(avg(internal_1) + avg(internal_2)) / 2')} as internals_avg,
           {r6('avg(assignment_completion)')} as assign_completion, {r6('avg(study_hours)')} as study_hours,
           {r6('avg(previous_gpa)')} as previous_gpa from records group by student_id
"""
FLAGS_SQL = """
    select *, coalesce(attendance_avg < 75, false) as attendance_avg_low, coalesce(internals_avg < 18, false) as internals_avg_low,
           coalesce(study_hours < 8, false) as study_hours_low, coalesce(assign_completion < 60, false) as assign_completion_low
    from indicators
"""
SCORECARD_SQL = f"""
    select department, count(distinct student_id) as student_count, {r6('avg(current_gpa)')} as avg_gpa,
           {r6('avg(attendance)')} as avg_attendance,
           row_number() over (order by {r6('avg(current_gpa)')} desc, department) as dept_rank
    from records where department is not null group by department
"""
BANDED_SQL = f"select {BAND_SQL} as attendance_group, {r6('avg(current_gpa)')} as avg_gpa, count(distinct student_id) as student_count from records group by 1"
TRENDS_SQL = f"select performance_trend, count(distinct student_id) as count, {r6('avg(current_gpa)')} as avg_gpa from records group by 1"
SUMMARY_SQL = f"select {r6('avg(current_gpa)')} as avg_gpa, {r6('avg(attendance)')} as avg_attendance, count(distinct student_id) as {{n}} from records"
MEANS_SQL = (
    f"select department, {r6('avg(current_gpa)')} as current_gpa, {r6('avg(attendance)')} as attendance_pct, "
    f"{r6('avg(study_hours)')} as study_hours, {r6('avg(lms_activity)')} as lms_activity "
    "from records where department is not null group by department"
)

ORACLES = {
    "filter_present": f"with {MEASURES_CTE} select {KEY}, quantity, price from m where quantity is not null and price is not null",
    "filter_facets": f"with {_RISK} select * from risk where risk_level = 'HIGH' and "
    "(lower(student_name) like '%r#00000000%' or lower(student_id) like '%r#00000000%')",
    "filter_facets_all": f"with {_RISK} select * from risk where department = 'MACHINERY' and student_id like '%7%'",
    "facet_values": f"with {RECORDS_CTE} select distinct department from records where department is not null",
    "project_points": f"with {RECORDS_CTE} select student_id, study_hours, attendance as attendance_pct, lms_activity "
    "from records where attendance is not null and study_hours is not null and lms_activity is not null",
    "filter_rank": f"with {MEASURES_CTE} select grp, price, rank() over (partition by grp order by price desc) as rnk from m "
    "where grp is not null and price is not null qualify rnk <= 10",
    "case_bands": f"with {RECORDS_CTE} select {BAND_SQL} as attendance_group, count(*) as rows from records group by 1",
    "join_inner": f"with {STAR_CTE} select student_id, subject_id, subject_name, {r6('performance_index')} as performance_index "
    "from subjects join student_performance using (subject_id)",
    "join_composite": f"with {STAR_CTE} select s.student_id, a.subject_id, student_name, {r6('current_gpa')} as current_gpa, "
    f"{r6('attendance_pct')} as attendance_pct from students s join student_performance p on s.student_id = p.student_id "
    "join attendance a on s.student_id = a.student_id and p.subject_id = a.subject_id",
    "join_salted": f"select {KEY}, l.l_returnflag, flag_rows from lineitem l join "
    "(select l_returnflag, count(*) as flag_rows from lineitem group by 1) f on l.l_returnflag = f.l_returnflag",
    "join_lookup_default": "with f as (select o_custkey, o_orderpriority from orders "
    "qualify row_number() over (partition by o_custkey order by o_orderkey) = 1) "
    "select c_custkey as student_id, cast(c_custkey as varchar) as student_name, coalesce(o_orderpriority, 'All') as department, "
    "1 as semester from customer left join f on c_custkey = o_custkey",
    "map_labels": "select o_orderkey, o_orderstatus, case o_orderstatus when 'F' then 'Filled' when 'O' then 'Open' end as label from orders",
    "join_anti_orphans": "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal >= 0)",
    "global_summary": f"with {RECORDS_CTE} {SUMMARY_SQL.format(n='entities')}",
    "two_level_avg": f"with {STAR_CTE}, e as (select p.student_id, avg(current_gpa) as g, avg(attendance_pct) as a "
    "from student_performance p join attendance using (student_id, subject_id) group by 1) "
    f"select {r6('avg(g)')} as avg_gpa, {r6('avg(a)')} as avg_attendance, count(*) as entities from e",
    "pass_fail_long": f"with {RECORDS_CTE} {pass_fail_sql_text('records')}",
    "pass_fail_wide": f"with {MEASURES_CTE} " + " union all ".join([
        _wide("quantity", "quantity_sold", "Quantity Sold"), _wide("discount", "line_discount", "Line Discount"), _wide("tax", "tax", "Tax")
    ]),
    "pass_fail_sql": f"with {STAR_CTE} select cast(p.subject_id as varchar) as subject_id, count(*) as total_students, "
    "cast(count_if(performance_index >= 50) as bigint) as passed_students, "
    f"{r6('100.0 * count_if(performance_index >= 50) / cast(count(*) as double)')} as pass_rate, "
    f"{r6('100.0 - ' + r6('100.0 * count_if(performance_index >= 50) / cast(count(*) as double)'))} as fail_rate, "
    f"{r6('avg(performance_index)')} as avg_score, {r6('avg(final_exam)')} as avg_final_exam "
    "from student_performance p join assessments using (student_id, subject_id) group by p.subject_id",
    "group_scorecard": f"with {RECORDS_CTE} {SCORECARD_SQL}",
    "banded_avg": f"with {RECORDS_CTE} {BANDED_SQL}",
    "trend_summary": f"with {RECORDS_CTE} {TRENDS_SQL}",
    "group_means": f"with {RECORDS_CTE} {MEANS_SQL}",
    "entity_rollup": f"with {RECORDS_CTE}, t as (select student_id, performance_trend, count(*) as n from records group by all), "
    "best as (select student_id, performance_trend from t qualify row_number() over (partition by student_id order by n desc, performance_trend) = 1), "
    f"r as (select student_id, {r6('avg(current_gpa)')} as current_gpa, {r6('avg(attendance)')} as attendance, "
    f"first(student_name {_FIRST}) as student_name, first(department {_FIRST}) filter (where department is not null) as department "
    "from records group by student_id) select r.*, performance_trend from r left join best using (student_id)",
    "group_mode": f"with {RECORDS_CTE}, t as (select student_id, subject, count(*) as n from records group by all) "
    "select student_id, subject from t qualify row_number() over (partition by student_id order by n desc, subject) = 1",
    "entity_indicators": f"with {RECORDS_CTE} {INDICATORS_SQL}",
    "indicator_flags": f"with {RECORDS_CTE}, indicators as ({INDICATORS_SQL}) {FLAGS_SQL}",
    "level_counts": f"with {_RISK} select cast(count_if(risk_level = 'HIGH') as bigint) as high_count, "
    "cast(count_if(risk_level = 'MEDIUM') as bigint) as medium_count, cast(count_if(risk_level = 'LOW') as bigint) as low_count from risk",
    "table_counts": "select 'customer' as table_name, 'entities' as description, count(*) as row_count from customer "
    "union all select 'part', 'items', count(*) from part union all select 'lineitem', 'facts', count(*) from lineitem "
    "union all select 'orders', 'links', count(*) from orders",
    "group_median": f"with {MEASURES_CTE} select grp, {r6('median(price)')} as median from m where grp is not null group by grp",
    "group_median_global": f"with {MEASURES_CTE} select {r6('median(price)')} as median from m",
    "rank_groups": f"with {RECORDS_CTE} select department, {r6('avg(current_gpa)')} as avg_score, count(distinct student_id) as entities, "
    f"rank() over (order by {r6('avg(current_gpa)')} desc) as rank from records where department is not null group by department",
    "rank_entities": f"with {RECORDS_CTE}, e as (select student_id, {r6('avg(current_gpa)')} as avg_gpa from records group by 1) "
    "select *, rank() over (order by avg_gpa desc) as gpa_rank from e where avg_gpa is not null",
    "dense_rank_top": f"with {RECORDS_CTE}, e as (select student_id, round_even(avg(attendance), 0) as attendance from records group by 1) "
    "select *, dense_rank() over (order by attendance desc) as rnk from e where attendance is not null qualify rnk <= 10",
    "position_rank": f"with {RECORDS_CTE}, e as (select subject, {r6('avg(attendance)')} as avg_attendance from records group by 1) "
    "select *, row_number() over (order by avg_attendance desc, subject) as position from e",
    "group_transform": f"with {MEASURES_CTE}, g as (select grp, {r6('avg(quantity)')} as group_mean, count(*) as group_rows from m "
    f"where grp is not null group by grp) select {KEY}, m.grp, quantity, group_mean, group_rows from m left join g on m.grp = g.grp",
    "average_ranks": f"with {MEASURES_CTE}, c as (select grp, price, count(*) as n from m where grp is not null and price is not null group by all) "
    "select grp, price, cast(coalesce(sum(n) over (partition by grp order by price rows between unbounded preceding and 1 preceding), 0) as double) "
    "+ (n + 1) / 2.0::double as rank from c",
    "top_k_entities": f"with {RECORDS_CTE} {TOP_SQL}",
    "order_results": f"with {_RISK} select department, risk_level, count(*) as n from risk group by all order by n desc, department, risk_level",
    "limit_rows": f"select {KEY}, l_quantity from lineitem order by {KEY} limit 5",
    "distinct_dims": f"with {RECORDS_CTE} select distinct subject, department from records",
    "distinct_on_key": "select o_custkey, o_orderkey, o_orderstatus, o_totalprice from orders "
    "qualify row_number() over (partition by o_custkey order by o_orderkey) = 1",
}
