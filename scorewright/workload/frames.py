"""Input frames over the test tables, as DataFrames and as the same SQL text.

Column expressions are written once in the SQL both engines share. Dirt (nulls,
outliers, padding, repeated and blank rows) comes from the rows' own values,
and every frame covers its whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

ORDER = ["l_orderkey", "l_partkey", "l_suppkey"]  # the input order; unique per line but for a few at the smallest scale


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(expression: str) -> str:
    """SQL for rounding to six digits, half to even."""
    return f"(round_even(({expression}) * 1e6, 0) / 1e6)"


def select_sql(columns: dict[str, str], source: str) -> str:
    return "select " + ", ".join(f'{e} as "{c}"' for c, e in columns.items()) + f" from {source}"


def select_df(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(c) for c, e in columns.items()])


# --- one row per order line, joined to its order, customer and part ------------

LINES_SQL = (
    "lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey "
    "join part on l_partkey = p_partkey"
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers meet the orders, parts the lines: no join moves the lines for a customer, and parts are met while rows are narrow."""
    def t(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    placed = t("orders").join(t("customer"), F.expr("o_custkey = c_custkey"))
    return t("lineitem").join(t("part"), F.expr("l_partkey = p_partkey")).join(placed, F.expr("l_orderkey = o_orderkey"))


# Clean records in the academic vocabulary, some values missing. The odd factors keep
# means off rounding ties, where the last bit of a sum would decide a digit.
_INDEX = (
    "(abs(l_discount) * 299.8712345 + abs(l_tax) * 374.8912345) / 60.0 * 100.0 * 0.3 + cast(p_size as double) * 2.0 * 0.2 "
    "+ o_totalprice / 4999.79 * 0.1 + l_extendedprice / 1049.97 * 0.4"
)
_GPA = f"(({_INDEX}) / 10.0)"
_PREVIOUS = "(abs(c_acctbal) / 999.77)"
_UNSCORED = "l_returnflag = 'N' and abs(l_discount) > 0.085"
RECORDS = {
    "student_id": "c_custkey",
    "student_name": "c_name",
    "department": "case when c_nationkey = 0 then null else c_mktsegment end",
    "semester": "l_linenumber",
    "academic_year": "cast(year(o_orderdate) as string)",
    "subject": "p_name",
    "attendance": "case when l_tax > 0.075 then null else l_quantity * 2.0 end",
    "internal_1": "abs(l_discount) * 299.8712345",
    "internal_2": "abs(l_tax) * 374.8912345",
    "assignment_score": "cast(p_size as double) * 2.0",
    "quiz_score": "o_totalprice / 4999.79",
    "final_exam": f"case when {_UNSCORED} then null else l_extendedprice / 1049.97 end",
    "previous_gpa": _PREVIOUS,
    "study_hours": "(p_retailprice - 900.0) * 0.2997312345",
    "lms_activity": "cast(floor(o_totalprice / 1000.0) as int)",
    "assignment_completion": "abs(l_tax) * 1249.8712345",
    "performance_index": f"case when {_UNSCORED} then null else {_INDEX} end",
    "current_gpa": f"case when {_UNSCORED} then null else {_GPA} end",
    "performance_change": f"case when {_UNSCORED} then null else {_GPA} - {_PREVIOUS} end",
    "performance_trend": (
        f"case when {_UNSCORED} then 'STABLE' when {_GPA} - {_PREVIOUS} > 0.3 then 'IMPROVING' "
        f"when {_GPA} - {_PREVIOUS} < -0.3 then 'DECLINING' else 'STABLE' end"
    ),
    "l_orderkey": "l_orderkey",
    "l_partkey": "l_partkey",
    "l_suppkey": "l_suppkey",
}
RECORDS_CTE = f"records as ({select_sql(RECORDS, LINES_SQL)})"


# the same order as one number
_SEQUENCE = (
    "cast(l_orderkey as decimal(20,0)) * 1000000000000000000 + cast(l_partkey as decimal(20,0)) * 1000000000 + l_suppkey"
)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat records with the input order as columns ORDER and as one number ``seq``."""
    return select_df(lines(spark, sf_dir), {**RECORDS, "seq": _SEQUENCE})


# --- the same vocabulary under other headers, as dirty text and numbers --------

RAW = {
    "Student ID": "cast(c_custkey as string)",
    "Student Name": "case when l_returnflag = 'A' then concat('  ', c_name, ' ') else c_name end",
    "Dept": "case when c_nationkey = 0 then 'None' when l_linestatus = 'O' then concat(c_mktsegment, '  ') "
            "else c_mktsegment end",
    "Semester": "l_linenumber",
    "Academic Year": "cast(year(o_orderdate) as string)",
    "Course Name": "case when l_linenumber = 7 then null when l_linenumber = 6 then concat(upper(p_name), ' ') "
                   "else p_name end",
    "Attendance %": "case when l_tax > 0.075 then null when l_tax < 0.005 then 'n/a' "
                    "when l_discount > 0.095 then '112.5' when abs(l_discount) < 0.005 then '-8.0' "
                    "else cast(l_quantity * 2.0 as string) end",
    "Internal 1": "case when l_quantity > 49.5 then 45.0 when l_quantity < 1.5 then null "
                  "else abs(l_discount) * 300.0 end",
    "Internal 2": "case when l_quantity > 48.5 then -2.5 else abs(l_tax) * 375.0 end",
    "Assignment Score": "case when p_size > 49 then null else cast(p_size as double) * 2.0 end",
    "Quiz Score": "case when o_orderpriority = '5-LOW' and l_linenumber = 1 then null else o_totalprice / 5000.0 end",
    "Final Exam Score": "case when l_quantity > 47.5 then 125.0 when l_quantity < 2.5 then -10.0 "
                        "else l_extendedprice / 1050.0 end",
    "Previous GPA": "case when c_acctbal < 0 then null else c_acctbal / 900.0 end",
    "Study Hours/Week": "(p_retailprice - 900.0) * 0.4",
    "LMS Activity": "cast(floor(o_totalprice / 800.0) as int)",
    "Assignment Completion %": "abs(l_tax) * 1250.0",
}
_REPEATED = "o_orderstatus = 'P' and l_returnflag = 'A' and l_linestatus = 'O'"
RAW_CTE = (
    f"raw as ({select_sql(RAW, LINES_SQL)} union all {select_sql(RAW, f'{LINES_SQL} where {_REPEATED}')} "
    f"union all {select_sql({c: 'null' for c in RAW}, 'supplier')})"
)
# canonical field -> raw header
RAW_MAPPING = {
    "student_id": "Student ID", "student_name": "Student Name", "department": "Dept", "semester": "Semester",
    "academic_year": "Academic Year", "subject": "Course Name", "attendance": "Attendance %",
    "internal_1": "Internal 1", "internal_2": "Internal 2", "assignment_score": "Assignment Score",
    "quiz_score": "Quiz Score", "final_exam": "Final Exam Score", "previous_gpa": "Previous GPA",
    "study_hours": "Study Hours/Week", "lms_activity": "LMS Activity",
    "assignment_completion": "Assignment Completion %",
}


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, one status-and-flag combination a second time, a blank row per supplier."""
    copies = F.when(F.expr(_REPEATED), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = select_df(lines(spark, sf_dir).select("*", F.explode(copies).alias("_copy")), RAW)  # one join for both
    suppliers = table(spark, sf_dir, "supplier")
    blanks = suppliers.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    return rows.unionByName(blanks)


# --- star tables: students = customers, subjects = parts -------------------------

FACTS_SQL = (
    "select o_custkey as student_id, l_partkey as subject_id, avg(l_quantity * 2.0) as attendance_pct, "
    "avg(l_extendedprice / 1049.97) as performance_index, avg(l_extendedprice / 10499.7) as current_gpa, "
    "avg(cast(p_size as double) * 2.0) as final_exam, avg(l_extendedprice / 10499.7) - avg(o_totalprice / 49997.9) as performance_change "
    "from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2"
)
_TREND = ("case when performance_change > 0.3 then 'IMPROVING' when performance_change < -0.3 then 'DECLINING' "
          "else 'STABLE' end")
STAR_CTE = (
    f"facts as ({FACTS_SQL}), "
    "students as (select c_custkey as student_id, c_name as student_name, c_mktsegment as department, "
    "c_nationkey as semester from customer), "
    "subjects as (select p_partkey as subject_id, p_name as subject_name, p_brand as department from part), "
    "attendance as (select student_id, subject_id, attendance_pct from facts), "
    "assessments as (select student_id, subject_id, final_exam from facts), "
    "student_performance as (select student_id, subject_id, performance_index, current_gpa, performance_change, "
    f"{_TREND} as performance_trend from facts)"
)


def star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Fact tables are cut from one grouping of the lines; its shuffle is shared."""
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    facts = (
        lineitem.join(orders, F.expr("l_orderkey = o_orderkey"))
        .join(part, F.expr("l_partkey = p_partkey"))
        .groupBy(F.col("o_custkey").alias("student_id"), F.col("l_partkey").alias("subject_id"))
        .agg(
            F.avg(F.expr("l_quantity * 2.0")).alias("attendance_pct"),
            F.avg(F.expr("l_extendedprice / 1049.97")).alias("performance_index"),
            F.avg(F.expr("l_extendedprice / 10499.7")).alias("current_gpa"),
            F.avg(F.expr("cast(p_size as double) * 2.0")).alias("final_exam"),
            (F.avg(F.expr("l_extendedprice / 10499.7")) - F.avg(F.expr("o_totalprice / 49997.9"))).alias(
                "performance_change"
            ),
        )
    )
    key = ["student_id", "subject_id"]
    return {
        "students": customer.select(
            F.col("c_custkey").alias("student_id"), F.col("c_name").alias("student_name"),
            F.col("c_mktsegment").alias("department"), F.col("c_nationkey").alias("semester"),
        ),
        "subjects": part.select(
            F.col("p_partkey").alias("subject_id"), F.col("p_name").alias("subject_name"),
            F.col("p_brand").alias("department"),
        ),
        "attendance": facts.select(*key, "attendance_pct"),
        "assessments": facts.select(*key, "final_exam"),
        "student_performance": facts.select(
            *key, "performance_index", "current_gpa", "performance_change", F.expr(_TREND).alias("performance_trend")
        ),
    }


# --- measures of the lines alone ---------------------------------------------------

MEASURES = {
    "entity": "l_orderkey",
    "grp": "case when l_linenumber = 7 then null else concat(l_returnflag, l_linestatus) end",
    "quantity": "case when l_tax > 0.075 then null else l_quantity end",
    "price": "case when l_discount > 0.095 then null else l_extendedprice end",
    "discount": "abs(l_discount) * 1000.0",
    "tax": "abs(l_tax) * 1000.0",
    "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey",
}
MEASURES_CTE = f"m as ({select_sql(MEASURES, 'lineitem')})"


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_df(table(spark, sf_dir, "lineitem"), MEASURES)


def union_sql(parts: list[str]) -> str:
    return reduce(lambda a, b: f"{a} union all {b}", parts)


# --- entities for risk models: orders, whose lines differ enough to label --------------

ORDER_RECORDS = {
    "student_id": "o_orderkey",
    "department": "o_orderstatus",
    "attendance": "case when l_tax > 0.075 then null else 50.0 + l_quantity end",
    "study_hours": "(p_retailprice - 900.0) * 0.2997312345",
    "lms_activity": "p_size * 10",
    "assignment_completion": "abs(l_discount) * 998.7123456",
    "quiz_score": "o_totalprice / 4999.79",
    "final_exam": "l_extendedprice / 1049.97",
    "current_gpa": "l_extendedprice / 10499.7",
    "performance_trend": "case l_returnflag when 'R' then 'DECLINING' when 'A' then 'IMPROVING' else 'STABLE' end",
    "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey",
}
_ORDER_LINES_SQL = "lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey"
ORDER_RECORDS_CTE = f"records as ({select_sql(ORDER_RECORDS, _ORDER_LINES_SQL)})"
ORDER_FEATURES = ["attendance", "study_hours", "lms_activity", "assignment_completion", "quiz_score", "final_exam"]
ORDER_BOUNDS = {"attendance": 70.0, "current_gpa": 4.0}


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "part")
    # orders last: what is then grouped by order is already dealt by it
    joined = lineitem.join(part, F.expr("l_partkey = p_partkey")).join(orders, F.expr("l_orderkey = o_orderkey"))
    return select_df(joined, {**ORDER_RECORDS, "seq": _SEQUENCE})
