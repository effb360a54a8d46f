"""Header matching, profiling and the quality report."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.operators import profile, quality
from scorewright.presets import ACADEMIC_RANGES, MeasureRule
from scorewright.sources.naming import harmonise, mapping_coverage
from scorewright.workload.frames import RAW, RAW_CTE, RAW_MAPPING, raw, records, table, union_sql

RANGES = {
    kind: [MeasureRule(RAW_MAPPING[r.column], r.high, r.fallback) for r in rules]
    for kind, rules in ACADEMIC_RANGES.items()
}
ALL_RANGES = [r for rules in RANGES.values() for r in rules]

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def number_sql(column: str) -> str:
    """SQL for parsing a text or number column to double."""
    text = f'cast("{column}" as varchar)'
    return f"case when regexp_matches({text}, '{_NUMBER}') then try_cast({text} as double) end"


def _sources(spark, sf_dir):
    """Customers, suppliers and parts, each with its own spelling of the canonical headers."""
    customer, supplier, part = (table(spark, sf_dir, n) for n in ("customer", "supplier", "part"))
    return {
        "customer": customer.select(
            F.col("c_custkey").cast("string").alias("Roll Number"), F.col("c_name").alias("Full Name"),
            F.col("c_mktsegment").alias(" DEPT "), F.col("c_acctbal").alias("Prev. GPA"),
        ),
        "supplier": supplier.select(
            F.col("s_suppkey").cast("string").alias("USN"), F.col("s_name").alias("name"),
            F.col("s_acctbal").alias("previous gpa"), F.col("s_nationkey").alias("Nation"),
        ),
        "part": part.select(
            F.col("p_partkey").cast("string").alias("student_id"), F.col("p_name").alias("Course Name"),
            F.col("p_size").alias("Study-Hours"), F.col("p_retailprice").alias("LMS Logins"),
        ),
    }


def harmonise_sources(spark, sf_dir):
    stacked = harmonise(_sources(spark, sf_dir), source_column="source")
    return stacked.select(
        "source", "student_id", "student_name", "department", "subject", "previous_gpa",
        "study_hours", "lms_activity", "Nation",
    )


def coverage(spark, sf_dir):
    return mapping_coverage(_sources(spark, sf_dir))


def profile_types(spark, sf_dir):
    return profile.profile_types(raw(spark, sf_dir).withColumn("Remarks", F.lit(None).cast("string")))


def numeric_coercible(spark, sf_dir):
    return profile.numeric_coercible(raw(spark, sf_dir))


def discover_measures(spark, sf_dir):
    """Score columns found among the records and the line keys."""
    rows = records(spark, sf_dir).drop("seq")
    names = profile.discover_measures(rows, ["semester"])
    return profile.column_counts(rows, names).select("column_name", "n_present")


def capabilities_long(spark, sf_dir):
    caps = profile.capabilities(records(spark, sf_dir).drop("l_orderkey", "l_partkey", "l_suppkey", "seq"))
    return caps.withColumn("wide_measures", F.array_join("wide_measures", ","))


def capabilities_wide(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("student_name"), "l_quantity", "l_extendedprice", "l_linestatus"
    )
    return profile.capabilities(wide).withColumn("wide_measures", F.array_join("wide_measures", ","))


def _ranges_report(spark, sf_dir):
    return quality.quality_report(raw(spark, sf_dir), RANGES)


_GRADES = ["missing_status", "duplicates_status", "marks_status", "attendance_status"]


def dq_status(spark, sf_dir):
    return _ranges_report(spark, sf_dir).select(*_GRADES)


def dq_overall(spark, sf_dir):
    return _ranges_report(spark, sf_dir).select("overall_status")


def quality_report(spark, sf_dir):
    return _ranges_report(spark, sf_dir).withColumn("missing_percentage", F.round("missing_percentage", 6))


def quality_report_clean(spark, sf_dir):
    """The same report on a table without dirt."""
    report = quality.quality_report(table(spark, sf_dir, "orders"), {})
    return report.withColumn("missing_percentage", F.round("missing_percentage", 6))


def quality_report_mapped(spark, sf_dir):
    """A frame with headers of its own, its ranges found by the mapping."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.expr("l_quantity * 2.5").alias("Exam"), F.expr("l_discount * 2000").alias("Presence"))
    report = quality.quality_report(rows, mapping={"final_exam": "Exam", "attendance": "Presence"})
    return report.select("total_rows", "total_columns", "invalid_marks", "invalid_attendance", "overall_status")


QUERIES = {
    "harmonise": harmonise_sources,
    "mapping_coverage": coverage,
    "profile_types": profile_types,
    "numeric_coercible": numeric_coercible,
    "discover_measures": discover_measures,
    "capabilities": capabilities_long,
    "capabilities_wide": capabilities_wide,
    "dq_counts": lambda spark, d: quality.dq_counts(raw(spark, d)),
    "dq_duplicates": lambda spark, d: quality.dq_duplicates(raw(spark, d)),
    "dq_missing": lambda spark, d: quality.dq_missing(raw(spark, d)).withColumn(
        "missing_percentage", F.round("missing_percentage", 6)
    ),
    "dq_missing_by_column": lambda spark, d: quality.dq_missing_by_column(raw(spark, d)),
    "dq_empty_columns": lambda spark, d: quality.dq_empty_columns(
        raw(spark, d).withColumn("Remarks", F.lit(None).cast("string"))
    ),
    "dq_range_violations": lambda spark, d: quality.dq_range_violations(raw(spark, d), ALL_RANGES),
    "dq_status": dq_status,
    "dq_overall": dq_overall,
    "quality_report": quality_report,
    "quality_report_clean": quality_report_clean,
    "quality_report_mapped": quality_report_mapped,
}

_NULLS = " + ".join(f'count(*) - count("{c}")' for c in RAW)
_VIOLATIONS = {
    r.column: f"count_if({number_sql(r.column)} > {r.high} or {number_sql(r.column)} < {r.low})" for r in ALL_RANGES
}
_MARKS = " + ".join(_VIOLATIONS[r.column] for r in RANGES["marks"])
_ATTENDANCE = " + ".join(_VIOLATIONS[r.column] for r in RANGES["attendance"])
_FIGURES_CTE = f"""
    {RAW_CTE}, distinct_rows as (select distinct * from raw),
    figures as (
        select count(*) as total_rows, cast({len(RAW)} as bigint) as total_columns,
               count(*) - (select count(*) from distinct_rows) as duplicates,
               cast({_NULLS} as bigint) as missing_count,
               cast({_MARKS} as bigint) as invalid_marks, cast({_ATTENDANCE} as bigint) as invalid_attendance,
               cast({' + '.join(f'case when count("{c}") = 0 then 1 else 0 end' for c in RAW)} as bigint) as empty_columns
        from raw
    ),
    graded as (
        select *, 100.0 * missing_count / cast(total_rows * total_columns as double) as missing_percentage,
               case when 100.0 * missing_count / cast(total_rows * total_columns as double) < 2 then 'GOOD'
                    when 100.0 * missing_count / cast(total_rows * total_columns as double) < 5 then 'WARNING'
                    else 'CRITICAL' end as missing_status,
               case when duplicates = 0 then 'GOOD' when duplicates < 10 then 'WARNING' else 'CRITICAL' end
                   as duplicates_status,
               case when invalid_marks = 0 then 'GOOD' when invalid_marks < 5 then 'WARNING' else 'CRITICAL' end
                   as marks_status,
               case when invalid_attendance = 0 then 'GOOD' when invalid_attendance < 5 then 'WARNING'
                    else 'CRITICAL' end as attendance_status
        from figures
    )
"""
_OVERALL = (
    "case when 'CRITICAL' in (missing_status, duplicates_status, marks_status, attendance_status) then 'CRITICAL' "
    "when 'WARNING' in (missing_status, duplicates_status, marks_status, attendance_status) then 'WARNING' "
    "else 'GOOD' end as overall_status"
)
_FIGURE_LIST = ("total_rows, total_columns, duplicates, missing_count, round(missing_percentage, 6) as missing_percentage, "
                "invalid_marks, invalid_attendance, empty_columns")


def _profile_sql(column: str, text: bool = True) -> str:
    numeric = f"count({number_sql(column)})"
    return (
        f"select '{column}' as column_name, count(*) as n_rows, count(\"{column}\") as n_present, "
        f"{numeric} as n_numeric from raw"
    )


def _coverage_sql() -> str:
    from scorewright.presets import ACADEMIC_SPELLINGS

    found = {
        "customer": {"student_id": ("Roll Number", "c_custkey"), "student_name": ("Full Name", "c_name"),
                     "department": (" DEPT ", "c_mktsegment"), "previous_gpa": ("Prev. GPA", "c_acctbal")},
        "supplier": {"student_id": ("USN", "s_suppkey"), "student_name": ("name", "s_name"),
                     "previous_gpa": ("previous gpa", "s_acctbal")},
        "part": {"student_id": ("student_id", "p_partkey"), "subject": ("Course Name", "p_name"),
                 "study_hours": ("Study-Hours", "p_size"), "lms_activity": ("LMS Logins", "p_retailprice")},
    }
    parts = []
    for source, fields in found.items():
        for fld in ACADEMIC_SPELLINGS:
            header, column = fields.get(fld, (None, None))
            shown = f"'{header}'" if header else "cast(null as varchar)"
            count = f"count({column})" if column else "cast(0 as bigint)"
            values = f"(select {count} from {source})" if column else count
            parts.append(
                f"select '{source}' as source, '{fld}' as field, {'true' if header else 'false'} as mapped, "
                f"{shown} as source_column, {values} as values_present"
            )
    return union_sql(parts)


_COUNTED = ", ".join(["missing_status", "duplicates_status", "marks_status", "attendance_status"])
ORACLES = {
    "harmonise": """
        select 'customer' as source, cast(c_custkey as varchar) as student_id, c_name as student_name,
               c_mktsegment as department, cast(null as varchar) as subject, c_acctbal as previous_gpa,
               cast(null as integer) as study_hours, cast(null as double) as lms_activity, cast(null as integer) as "Nation"
        from customer
        union all
        select 'supplier', cast(s_suppkey as varchar), s_name, null, null, s_acctbal, null, null, s_nationkey from supplier
        union all
        select 'part', cast(p_partkey as varchar), null, null, p_name, null, p_size, p_retailprice, null from part
    """,
    "mapping_coverage": _coverage_sql(),
    "profile_types": f"""
        with {RAW_CTE}, counted as ({union_sql([_profile_sql(c) for c in RAW])}
            union all select 'Remarks', count(*), 0, 0 from raw)
        select column_name, n_rows, n_present, n_numeric,
               case when n_present = 0 then 'empty' when n_present = n_numeric then 'numeric' else 'text' end
                   as detected_type
        from counted
    """,
    "numeric_coercible": f"""
        with {RAW_CTE}, counted as ({union_sql([_profile_sql(c) for c in RAW])})
        select column_name, n_present > 0 and n_present = n_numeric as coercible from counted
    """,
    "discover_measures": "select 'l_orderkey' as column_name, count(*) as n_present from lineitem "
    "union all select 'l_partkey', count(*) from lineitem union all select 'l_suppkey', count(*) from lineitem",
    "capabilities": """
        select true as entity_reports, true as subject_reports, true as marks_reports, true as attendance_reports,
               true as score_reports, true as group_reports, true as term_reports, true as behavior_reports,
               '' as wide_measures, 'long' as layout
    """,
    "capabilities_wide": """
        select true as entity_reports, true as subject_reports, true as marks_reports, false as attendance_reports,
               false as score_reports, false as group_reports, false as term_reports, false as behavior_reports,
               case when count(l_quantity) > 0 and count(l_extendedprice) > 0 then 'l_quantity,l_extendedprice' end
                   as wide_measures,
               'wide' as layout
        from lineitem
    """,
    "dq_counts": f"with {RAW_CTE} select count(*) as total_rows, cast({len(RAW)} as bigint) as total_columns from raw",
    "dq_duplicates": f"with {RAW_CTE}, d as (select distinct * from raw) "
    "select (select count(*) from raw) - (select count(*) from d) as duplicates",
    "dq_missing": f"with {_FIGURES_CTE} select missing_count, round(missing_percentage, 6) as missing_percentage from graded",
    "dq_missing_by_column": f"with {RAW_CTE} "
    + union_sql([f"select '{c}' as column_name, count(*) - count(\"{c}\") as missing_count from raw" for c in RAW]),
    "dq_empty_columns": f"with {_FIGURES_CTE} select empty_columns + 1 as empty_columns from graded",
    "dq_range_violations": f"with {RAW_CTE} " + union_sql([
        f"select '{r.column}' as column_name, cast({r.low} as double) as low, cast({r.high} as double) as high, "
        f"cast({_VIOLATIONS[r.column]} as bigint) as violations from raw" for r in ALL_RANGES
    ]),
    "dq_status": f"with {_FIGURES_CTE} select {_COUNTED} from graded",
    "dq_overall": f"with {_FIGURES_CTE} select {_OVERALL} from graded",
    "quality_report": f"with {_FIGURES_CTE} select {_FIGURE_LIST}, {_COUNTED}, {_OVERALL} from graded",
    "quality_report_clean": """
        select count(*) as total_rows, cast(6 as bigint) as total_columns,
               count(*) - (select count(*) from (select distinct * from orders)) as duplicates,
               cast(0 as bigint) as missing_count, cast(0 as double) as missing_percentage,
               cast(0 as bigint) as invalid_marks, cast(0 as bigint) as invalid_attendance,
               cast(0 as bigint) as empty_columns, 'GOOD' as missing_status, 'GOOD' as duplicates_status,
               'GOOD' as marks_status, 'GOOD' as attendance_status, 'GOOD' as overall_status
        from orders
    """,
    "quality_report_mapped": """
        select count(*) as total_rows, cast(4 as bigint) as total_columns,
               count(*) filter (l_quantity * 2.5 not between 0 and 100) as invalid_marks,
               count(*) filter (l_discount * 2000 not between 0 and 100) as invalid_attendance, 'CRITICAL' as overall_status from lineitem
    """,
}
