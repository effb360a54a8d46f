"""Cleaning, derivation, the star split and its constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.functions.numbers import parse_number, round_even
from scorewright.functions.text import clean_text, derive_key, display_name, one_decimal, title_case
from scorewright.operators import cleaning as C
from scorewright.operators import star as S
from scorewright.presets import ACADEMIC_RULES, NUMERIC_FIELDS, TEXT_FIELDS, MeasureRule
from scorewright.sources.naming import rename_mapped
from scorewright.workload.frames import (
    MEASURES_CTE, ORDER, RAW_CTE, RAW_MAPPING, RECORDS_CTE, measures, r6, raw, records, table, union_sql,
)
from scorewright.workload.profiling import number_sql

MEASURE_RULES = [MeasureRule("quantity", 40.0, 0.0, low=5.0), MeasureRule("price", 90000.0, 0.0),
                 MeasureRule("discount", 80.0, 0.0, low=10.0)]


def _six(df, *columns):
    return df.withColumns({c: round_even(F.col(c), 6) for c in columns})


def drop_blank_rows(spark, sf_dir):
    return C.drop_blank_rows(raw(spark, sf_dir)).select("Student ID", "Course Name", "Semester")


def dedup_rows(spark, sf_dir):
    return C.dedup_rows(raw(spark, sf_dir))


def rename_columns(spark, sf_dir):
    return rename_mapped(raw(spark, sf_dir), RAW_MAPPING).select("student_id", "subject", "final_exam", "study_hours")


def clean_text_columns(spark, sf_dir):
    """Every text column of the raw frame, trimmed and with missing tokens nulled."""
    rows = rename_mapped(raw(spark, sf_dir), RAW_MAPPING)
    return C.clean_text_columns(rows, TEXT_FIELDS, title=[]).select(*TEXT_FIELDS)


def clean_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean_text(F.col("text"))).alias("digest"))


def title_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", title_case(F.col("text")).alias("titled"))


def title_subjects(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.expr("concat(p_name, '/', p_type, '-', lower(p_brand))").alias("name"))
    return names.select("name", title_case(F.col("name")).alias("titled"))


def coerce_numeric(spark, sf_dir):
    rows = rename_mapped(raw(spark, sf_dir), RAW_MAPPING)
    return C.coerce_numeric(rows, NUMERIC_FIELDS).select("student_id", *NUMERIC_FIELDS)


def parse_texts(spark, sf_dir):
    """Numbers in texts: only whole texts count, suffixes do not."""
    orders = table(spark, sf_dir, "orders")
    text = F.expr(
        "case o_orderstatus when 'P' then concat(cast(o_custkey as string), 'd') "
        "when 'F' then concat(' ', cast(o_totalprice as string)) else concat('+', cast(o_custkey as string), 'e1') end"
    )
    return orders.select("o_orderkey", text.alias("raw_text")).withColumn("number", parse_number(F.col("raw_text")))


def clip_range(spark, sf_dir):
    return C.clip_range(measures(spark, sf_dir), MEASURE_RULES).select(*ORDER, "quantity", "price", "discount")


def impute_group_median(spark, sf_dir):
    rows = C.impute_group_median(measures(spark, sf_dir), MEASURE_RULES, "grp")
    return _six(rows.select(*ORDER, "quantity", "price", "discount"), "quantity", "price", "discount")


def impute_global_median(spark, sf_dir):
    rows = C.impute_group_median(measures(spark, sf_dir), MEASURE_RULES)
    return _six(rows.select(*ORDER, "quantity", "price"), "quantity", "price")


def cleaning_audit(spark, sf_dir):
    return C.cleaning_audit(raw(spark, sf_dir), RAW_MAPPING)


def cleaning_audit_by_column(spark, sf_dir):
    return C.cleaning_audit_by_column(raw(spark, sf_dir), RAW_MAPPING)


def weighted_index(spark, sf_dir):
    rows = C.weighted_index(records(spark, sf_dir), alias="score_index")
    return rows.select(*ORDER, "score_index")


def weighted_index_partial(spark, sf_dir):
    """Own weights, and no quiz column."""
    rows = records(spark, sf_dir).drop("quiz_score", "internal_2")
    weights = {"internal": 25.0, "assignment": 25.0, "quiz": 10.0, "final_exam": 40.0}
    return _six(C.weighted_index(rows, weights, alias="score_index", digits=None).select(*ORDER, "score_index"), "score_index")


def row_mean_index(spark, sf_dir):
    rows = C.row_mean_index(measures(spark, sf_dir), ["quantity", "discount", "tax", "price"], digits=None)
    return _six(rows.select(*ORDER, "performance_index"), "performance_index")


def scale_score(spark, sf_dir):
    rows = records(spark, sf_dir)
    return C.scale_score(rows, "final_exam", "scaled").select(*ORDER, "scaled")


def score_change(spark, sf_dir):
    rows = C.score_change(records(spark, sf_dir).drop("performance_change"))
    return rows.select(*ORDER, "performance_change")


def trend_label(spark, sf_dir):
    rows = C.score_change(records(spark, sf_dir).drop("performance_change", "performance_trend"))
    return C.trend_label(rows).groupBy("performance_trend").agg(F.count(F.lit(1)).alias("rows"))


def derive_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", derive_key(F.col("text")).alias("derived_key"))


def scalar_text_format(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumn("quarter", F.floor(F.abs("c_acctbal")) / 4.0)
    text = F.format_string("Balance of %s is %s%%.", F.col("c_name"), one_decimal(F.col("quarter")))
    return customers.select("c_custkey", text.alias("message"))


def display_names(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", display_name(F.expr("concat(replace(p_name, ' ', '_'), '_marks')")).alias("heading"))


def clean_records(spark, sf_dir):
    """All cleaning steps over the whole raw frame."""
    rows = C.clean_records(raw(spark, sf_dir), RAW_MAPPING)
    return rows


def _wide(spark, sf_dir, maths="maths"):
    return table(spark, sf_dir, "lineitem").select(
        F.expr("concat('L', l_orderkey, '-', l_partkey, '-', l_suppkey)").alias("Name"),
        F.expr("case when l_tax > 0.075 then null else l_quantity * 2.5 end").alias(maths),
        F.expr("case when l_discount > 0.095 then null else l_extendedprice / 1000.0 end").alias("science"),
        F.expr("case when l_tax < 0.005 then -1.0 else abs(l_tax) * 1000.0 end").alias("english"),
    )


def clean_records_wide(spark, sf_dir):
    """One row per line with score columns only: discovered, clipped, filled and averaged."""
    return C.clean_records(_wide(spark, sf_dir), {"student_name": "Name"})


def clean_records_dotted(spark, sf_dir):
    """The same with a score column that has a dot in its name."""
    return C.clean_records(_wide(spark, sf_dir, "maths.1"), {"student_name": "Name"}).withColumnsRenamed({"maths.1": "maths"})


def cleaning_audit_wide(spark, sf_dir):
    """What cleaning changes in discovered score columns."""
    return C.cleaning_audit(_wide(spark, sf_dir, "maths.1"), {"student_name": "Name"}, measures=["maths.1", "science", "english"])


# at the smallest scale a few lines share all three keys
_STAR_ORDER = [*ORDER, "semester", "internal_1"]


def _star(spark, sf_dir):
    return S.split_star(records(spark, sf_dir).na.fill({"department": "GENERAL"}), _STAR_ORDER)


def split_star(name):
    return lambda spark, sf_dir: _star(spark, sf_dir)[name]


def key_collisions(spark, sf_dir):
    """Keys cut to four characters, which several part names share."""
    return S.key_collisions(table(spark, sf_dir, "part"), "p_name", 4)


def _constraint_tables(spark, sf_dir):
    """Customers as students, parts as subjects, lines as facts: some keys repeat, some have no parent."""
    customer, part = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    rows = records(spark, sf_dir)
    return {
        "students": customer.where("c_acctbal >= 0").select(
            F.col("c_custkey").alias("student_id"), F.col("c_name").alias("student_name"),
            F.expr("case when c_nationkey = 0 then null else c_mktsegment end").alias("department"),
            F.col("c_nationkey").alias("semester"), F.col("c_name").alias("academic_year"),
            F.expr("c_acctbal / 900.0").alias("previous_gpa"),
        ),
        "subjects": part.select(
            F.col("p_partkey").alias("subject_id"), F.col("p_name").alias("subject_name"), F.col("p_type").alias("department")
        ),
        "attendance": rows.select(
            "student_id", F.col("l_partkey").alias("subject_id"), F.expr("attendance + 10").alias("attendance_pct")
        ),
    }


def check_constraints(spark, sf_dir):
    return S.check_constraints(_constraint_tables(spark, sf_dir))


def split_valid(spark, sf_dir):
    tables = _constraint_tables(spark, sf_dir)
    good, bad = S.split_valid(tables["attendance"], S.STAR_RULES["attendance"], tables, unique=False)

    def count(df, verdict):
        return df.agg(F.count(F.lit(1)).alias("rows"), F.sum("student_id").alias("id_sum")).withColumn("verdict", F.lit(verdict))

    return count(good, "accepted").unionByName(count(bad, "quarantined"))


def split_valid_rows(spark, sf_dir):
    """Every fact row with the constraints it violates, repeated keys among them."""
    tables = _constraint_tables(spark, sf_dir)
    rows = S.judged(tables["attendance"], S.STAR_RULES["attendance"], tables)
    return rows.select("student_id", "subject_id", F.round("attendance_pct", 6).alias("attendance_pct"),
                       F.array_join("reasons", ";").alias("reasons"))


QUERIES = {
    "drop_blank_rows": drop_blank_rows,
    "dedup_rows": dedup_rows,
    "rename_mapped": rename_columns,
    "clean_text": clean_text_columns,
    "clean_text_documents": clean_documents,
    "title_case": title_documents,
    "title_case_subjects": title_subjects,
    "coerce_numeric": coerce_numeric,
    "parse_number": parse_texts,
    "clip_range": clip_range,
    "impute_group_median": impute_group_median,
    "impute_global_median": impute_global_median,
    "cleaning_audit": cleaning_audit,
    "cleaning_audit_by_column": cleaning_audit_by_column,
    "weighted_index": weighted_index,
    "weighted_index_partial": weighted_index_partial,
    "row_mean_index": row_mean_index,
    "scale_score": scale_score,
    "score_change": score_change,
    "trend_label": trend_label,
    "derive_key": derive_keys,
    "scalar_text_format": scalar_text_format,
    "display_name": display_names,
    "clean_records": clean_records,
    "clean_records_wide": clean_records_wide,
    "clean_records_dotted": clean_records_dotted,
    "cleaning_audit_wide": cleaning_audit_wide,
    "split_star_students": split_star("students"),
    "split_star_subjects": split_star("subjects"),
    "split_star_learning_behavior": split_star("learning_behavior"),
    "split_star_attendance": split_star("attendance"),
    "split_star_assessments": split_star("assessments"),
    "split_star_student_performance": lambda spark, d: _six(
        _star(spark, d)["student_performance"], "performance_index", "current_gpa", "performance_change"
    ),
    "key_collisions": key_collisions,
    "check_constraints": check_constraints,
    "split_valid": split_valid,
    "split_valid_rows": split_valid_rows,
}

_KEY = ", ".join(ORDER)
_BLANKS = r"' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def _clean_sql(expression: str) -> str:
    stripped = f"trim(cast({expression} as varchar), {_BLANKS})"
    return f"case when {stripped} not in ('nan', 'None', '') then {stripped} end"


def _title_sql(expression: str) -> str:
    """Runs of letters with the first one in upper case, everything else as it is."""
    pieces = f"regexp_extract_all(lower({expression}), '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+')"
    titled = f"array_to_string(list_transform({pieces}, lambda x: upper(x[1]) || x[2:]), '')"
    return f"replace({titled}, chr(7838), 'Ss')"  # the title form of the sharp s


def _clip_sql(column: str, low: float, high: float) -> str:
    return f"case when {column} < {low} then cast({low} as double) when {column} > {high} then cast({high} as double) else {column} end"


def _np_round(expression: str, digits: int = 2) -> str:
    return f"(round_even(({expression}) * 1e{digits}, 0) / 1e{digits})"


_PRESENT = " or ".join(f'"{c}" is not null' for c in RAW_MAPPING.values())
_NONBLANK_CTE = f"{RAW_CTE}, nonblank as (select * from raw where {_PRESENT}), deduped as (select distinct * from nonblank)"

_RULES = {r.column: r for r in ACADEMIC_RULES}


def _clean_records_cte() -> str:
    texts = {f: _clean_sql(f'"{RAW_MAPPING[f]}"') for f in TEXT_FIELDS}
    texts["subject"] = _title_sql(texts["subject"])
    numbers = {f: number_sql(RAW_MAPPING[f]) for f in NUMERIC_FIELDS}
    columns = ", ".join([*(f"{e} as {f}" for f, e in texts.items()), '"Semester" as semester',
                         *(f"{e} as {f}" for f, e in numbers.items())])
    clipped = ", ".join(f"{_clip_sql(f, _RULES[f].low, _RULES[f].high)} as {f}" for f in NUMERIC_FIELDS)
    medians = ", ".join(f"median({f}) as {f}" for f in NUMERIC_FIELDS)
    filled = ", ".join(
        f"coalesce(c.{f}, g.{f}, (select {f} from overall), {_RULES[f].fallback}) as {f}" for f in NUMERIC_FIELDS
    )
    rest = ", ".join(f"c.{f}" for f in [*TEXT_FIELDS, "semester"])
    index = ("(internal_1 + internal_2) / 60.0 * 100.0 * 0.3 + assignment_score * 0.2 + quiz_score * 0.1 + final_exam * 0.4")
    return f"""
        {_NONBLANK_CTE},
        parsed as (select {columns} from deduped),
        clipped as (select {', '.join(TEXT_FIELDS)}, semester, {clipped} from parsed),
        overall as (select {medians} from clipped),
        by_subject as (select subject, {medians} from clipped where subject is not null group by subject),
        filled as (select {rest}, {filled} from clipped c left join by_subject g on c.subject = g.subject),
        indexed as (select *, {_np_round(index)} as performance_index from filled),
        scaled as (select *, {_np_round('performance_index / 10.0')} as current_gpa from indexed),
        changed as (select *, {_np_round('current_gpa - previous_gpa')} as performance_change from scaled),
        cleaned as (select *, case when performance_change > 0.3 then 'IMPROVING'
                                   when performance_change < -0.3 then 'DECLINING' else 'STABLE' end as performance_trend
                    from changed)
    """


_FILLED_BY = {
    c: f"coalesce(m.{c}, g.{c}, (select median({c}) from m), 0)" for c in ("quantity", "price", "discount")
}
_GENERAL = RECORDS_CTE.replace(
    "case when c_nationkey = 0 then null else c_mktsegment end", "case when c_nationkey = 0 then 'GENERAL' else c_mktsegment end"
)
_SUBJECT_KEY = "upper(substr(regexp_replace(subject, '[^a-zA-Z0-9]', '', 'g'), 1, 10))"
_STAR = f"""
    with {_GENERAL}, keyed as (select *, {_SUBJECT_KEY} as subject_id,
        row_number() over (order by {', '.join(_STAR_ORDER)}) as seq from records),
    firsts as (select * from keyed qualify row_number() over (partition by student_id order by seq) = 1),
    lasts as (select * from keyed qualify row_number() over (partition by student_id, subject_id order by seq desc) = 1),
    pairs as (select subject_id, subject, department, min(seq) as seen from keyed group by all)
"""
_BAD_ATT = "student_id is null or subject_id is null or coalesce(attendance_pct not between 0 and 100, false)"
_CONSTRAINTS = f"""
    {RECORDS_CTE},
    students as (select c_custkey as student_id, c_name as student_name,
                 case when c_nationkey = 0 then null else c_mktsegment end as department, c_nationkey as semester,
                 c_name as academic_year, c_acctbal / 900.0 as previous_gpa from customer where c_acctbal >= 0),
    subjects as (select p_partkey as subject_id, p_name as subject_name, p_type as department from part),
    att as (select student_id, l_partkey as subject_id, attendance + 10 as attendance_pct from records)
"""


def _violation(table_name: str, rule: str, columns: str, select: str) -> str:
    return f"select '{table_name}' as table_name, '{rule}' as rule, '{columns}' as columns, ({select}) as violations"


_CONSTRAINT_ROWS = union_sql(
    [_violation("students", "not_null", c, f"select count(*) from students where {c} is null")
     for c in ("student_id", "student_name", "department", "semester", "academic_year")]
    + [_violation("subjects", "not_null", c, f"select count(*) from subjects where {c} is null")
       for c in ("subject_id", "subject_name", "department")]
    + [_violation("attendance", "not_null", c, f"select count(*) from att where {c} is null")
       for c in ("student_id", "subject_id")]
    + [
        _violation("students", "range", "previous_gpa", "select count(*) from students where previous_gpa not between 0 and 10"),
        _violation("attendance", "range", "attendance_pct", "select count(*) from att where attendance_pct not between 0 and 100"),
        _violation("students", "unique", "student_id", "select count(*) - count(distinct student_id) from students"),
        _violation("subjects", "unique", "subject_id", "select count(*) - count(distinct subject_id) from subjects"),
        _violation("attendance", "unique", "student_id,subject_id",
                   "select count(*) - count(distinct (student_id, subject_id)) from att"),
        _violation("attendance", "foreign_key", "student_id->students",
                   "select count(*) from att where student_id not in (select student_id from students)"),
        _violation("attendance", "foreign_key", "subject_id->subjects",
                   "select count(*) from att where subject_id not in (select subject_id from subjects)"),
    ]
)

ORACLES = {
    "drop_blank_rows": f"with {_NONBLANK_CTE} select \"Student ID\", \"Course Name\", \"Semester\" from nonblank",
    "dedup_rows": f"with {RAW_CTE} select distinct * from raw",
    "rename_mapped": f'with {RAW_CTE} select "Student ID" as student_id, "Course Name" as subject, '
    '"Final Exam Score" as final_exam, "Study Hours/Week" as study_hours from raw',
    "clean_text": f"with {RAW_CTE} select "
    + ", ".join(f"{_clean_sql(chr(34) + RAW_MAPPING[f] + chr(34))} as {f}" for f in TEXT_FIELDS) + " from raw",
    "clean_text_documents": f"select doc_id, md5({_clean_sql('text')}) as digest from documents",
    "title_case": f"select doc_id, {_title_sql('text')} as titled from documents",
    "title_case_subjects": "with n as (select concat(p_name, '/', p_type, '-', lower(p_brand)) as name from part) "
    f"select name, {_title_sql('name')} as titled from n",
    "coerce_numeric": f'with {RAW_CTE} select "Student ID" as student_id, '
    + ", ".join(f"{number_sql(RAW_MAPPING[f])} as {f}" for f in NUMERIC_FIELDS) + " from raw",
    "parse_number": "with t as (select o_orderkey, case o_orderstatus when 'P' then concat(cast(o_custkey as string), 'd') "
    "when 'F' then concat(' ', cast(o_totalprice as string)) else concat('+', cast(o_custkey as string), 'e1') end as raw_text "
    "from orders) select o_orderkey, raw_text, case when raw_text like '%d' then null else "
    "cast(replace(trim(raw_text), '+', '') as double) end as number from t",
    "clip_range": f"with {MEASURES_CTE} select {_KEY}, {_clip_sql('quantity', 5.0, 40.0)} as quantity, "
    f"{_clip_sql('price', 0.0, 90000.0)} as price, {_clip_sql('discount', 10.0, 80.0)} as discount from m",
    "impute_group_median": f"with {MEASURES_CTE}, g as (select grp, median(quantity) as quantity, median(price) as price, "
    "median(discount) as discount from m where grp is not null group by grp) select "
    + _KEY.replace("l_", "m.l_") + ", " + ", ".join(f"{r6(e)} as {c}" for c, e in _FILLED_BY.items())
    + " from m left join g on m.grp = g.grp",
    "impute_global_median": f"with {MEASURES_CTE} select {_KEY}, "
    + ", ".join(f"{r6(f'coalesce({c}, (select median({c}) from m))')} as {c}" for c in ("quantity", "price")) + " from m",
    "cleaning_audit": f"""
        with {_NONBLANK_CTE}, parsed as (select *,
            {', '.join(f'{number_sql(RAW_MAPPING[f])} as {f}' for f in NUMERIC_FIELDS)} from deduped)
        select (select count(*) from nonblank) - (select count(*) from deduped) as duplicates_removed,
               cast({' + '.join(f'count_if({f} is null) + count_if({f} is null and "{RAW_MAPPING[f]}" is not null)'
                                for f in NUMERIC_FIELDS)} as bigint) as missing_filled,
               cast({' + '.join(f'count_if({f} > {_RULES[f].high} or {f} < 0)' for f in NUMERIC_FIELDS
                                if _RULES[f].family == 'marks')} as bigint) as marks_corrected,
               cast({' + '.join(f'count_if({f} > {_RULES[f].high} or {f} < 0)' for f in NUMERIC_FIELDS
                                if _RULES[f].family != 'marks')} as bigint) as attendance_corrected,
               cast(count_if({' or '.join(f'coalesce(trim(cast("{RAW_MAPPING[f]}" as varchar), {_BLANKS}) <> "{RAW_MAPPING[f]}", false)'
                                     for f in TEXT_FIELDS)}) as bigint) as trimmed_records
        from parsed
    """,
    "cleaning_audit_by_column": f"""
        with {_NONBLANK_CTE}, parsed as (select *,
            {', '.join(f'{number_sql(RAW_MAPPING[f])} as {f}' for f in NUMERIC_FIELDS)} from deduped)
    """ + union_sql([
        f"select '{f}' as column_name, cast(count_if({f} is null and \"{RAW_MAPPING[f]}\" is not null) as bigint) as coerced, "
        f"cast(count_if({f} is null) as bigint) as filled, "
        f"cast(count_if({f} > {_RULES[f].high} or {f} < 0) as bigint) as corrected from parsed"
        for f in NUMERIC_FIELDS
    ]),
    "weighted_index": f"with {RECORDS_CTE} select {_KEY}, "
    + _np_round("(internal_1 + internal_2) / 60.0 * 100.0 * 0.3 + assignment_score * 0.2 + quiz_score * 0.1 + final_exam * 0.4")
    + " as score_index from records",
    "weighted_index_partial": f"with {RECORDS_CTE} select {_KEY}, "
    + r6("internal_1 / 60.0 * 100.0 * (25.0::double / 90) + assignment_score * (25.0::double / 90) + final_exam * (40.0::double / 90)")
    + " as score_index from records",
    "row_mean_index": f"with {MEASURES_CTE} select {_KEY}, "
    + r6("(coalesce(quantity, 0) + discount + tax + coalesce(price, 0)) / (2 + (quantity is not null)::int + (price is not null)::int)")
    + " as performance_index from m",
    "scale_score": f"with {RECORDS_CTE} select {_KEY}, {_np_round('final_exam / 10.0')} as scaled from records",
    "score_change": f"with {RECORDS_CTE} select {_KEY}, {_np_round('current_gpa - previous_gpa')} as performance_change from records",
    "trend_label": f"with {RECORDS_CTE}, c as (select {_np_round('current_gpa - previous_gpa')} as d from records) "
    "select case when d > 0.3 then 'IMPROVING' when d < -0.3 then 'DECLINING' else 'STABLE' end as performance_trend, "
    "count(*) as rows from c group by 1",
    "derive_key": "select doc_id, upper(substr(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g'), 1, 10)) as derived_key from documents",
    "scalar_text_format": "select c_custkey, printf('Balance of %s is %.1f%%.', c_name, floor(abs(c_acctbal)) / 4.0) as message from customer",
    "display_name": "select p_partkey, " + _title_sql("replace(concat(replace(p_name, ' ', '_'), '_marks'), '_', ' ')")
    + " as heading from part",
    "clean_records": f"with {_clean_records_cte()} select * from cleaned",
    "clean_records_wide": f"""
        with w as (select concat('L', l_orderkey, '-', l_partkey, '-', l_suppkey) as student_name,
                case when l_tax > 0.075 then null else l_quantity * 2.5 end as maths,
                case when l_discount > 0.095 then null else l_extendedprice / 1000.0 end as science,
                case when l_tax < 0.005 then -1.0 else abs(l_tax) * 1000.0 end as english from lineitem),
        c as (select student_name, {', '.join(f'{_clip_sql(f, 0.0, 100.0)} as {f}' for f in ('maths', 'science', 'english'))}
              from (select distinct * from w)),
        f as (select student_name, {', '.join(f'coalesce({f}, (select median({f}) from c)) as {f}' for f in ('maths', 'science', 'english'))} from c),
        i as (select *, {_np_round('(maths + science + english) / 3.0')} as performance_index from f)
        select *, {_np_round('performance_index / 10.0')} as current_gpa, cast(0 as double) as performance_change,
               'STABLE' as performance_trend from i
    """,
    "split_star_students": f"{_STAR} select student_id, student_name, department, semester, academic_year, previous_gpa from firsts",
    "split_star_subjects": f"{_STAR} select subject_id, subject as subject_name, department from pairs "
    "qualify row_number() over (partition by subject_id order by seen desc) = 1",
    "split_star_learning_behavior": f"{_STAR} select student_id, study_hours, lms_activity from firsts",
    "split_star_attendance": f"{_STAR} select student_id, subject_id, attendance as attendance_pct from lasts",
    "split_star_assessments": f"{_STAR} select student_id, subject_id, internal_1, internal_2, assignment_score, quiz_score, "
    "final_exam, assignment_completion from lasts",
    "split_star_student_performance": f"{_STAR} select student_id, subject_id, {r6('performance_index')} as performance_index, "
    f"{r6('current_gpa')} as current_gpa, {r6('performance_change')} as performance_change, performance_trend from lasts",
    "key_collisions": "with n as (select distinct p_name from part) select "
    "upper(substr(regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g'), 1, 4)) as derived_key, count(*) as names "
    "from n group by 1 having count(*) > 1",
    "check_constraints": f"with {_CONSTRAINTS} {_CONSTRAINT_ROWS}",
    "split_valid": f"""
        with {_CONSTRAINTS}, judged as (select student_id, ({_BAD_ATT})
            or student_id not in (select student_id from students)
            or subject_id not in (select subject_id from subjects) as bad from att)
        select case when bad then 'quarantined' else 'accepted' end as verdict, count(*) as rows,
               cast(sum(student_id) as bigint) as id_sum from judged group by 1
    """,
    "split_valid_rows": f"""
        with {_CONSTRAINTS}, counted as (select *, count(*) over (partition by student_id, subject_id) as copies from att)
        select student_id, subject_id, round(attendance_pct, 6) as attendance_pct, concat_ws(';',
            case when student_id is null then 'not_null:student_id' end, case when subject_id is null then 'not_null:subject_id' end,
            case when attendance_pct not between 0 and 100 then 'range:attendance_pct' end,
            case when copies > 1 and student_id is not null and subject_id is not null then 'unique:student_id,subject_id' end,
            case when student_id not in (select student_id from students) then 'foreign_key:student_id->students' end,
            case when subject_id not in (select subject_id from subjects) then 'foreign_key:subject_id->subjects' end) as reasons
        from counted
    """,
}
ORACLES["clean_records_dotted"] = ORACLES["clean_records_wide"]
ORACLES["cleaning_audit_wide"] = """
    with w as (select concat('L', l_orderkey, '-', l_partkey, '-', l_suppkey) as student_name,
            case when l_tax > 0.075 then null else l_quantity * 2.5 end as maths,
            case when l_discount > 0.095 then null else l_extendedprice / 1000.0 end as science,
            case when l_tax < 0.005 then -1.0 else abs(l_tax) * 1000.0 end as english from lineitem),
    d as (select distinct * from w)
    select (select count(*) from w) - count(*) as duplicates_removed,
           count(*) filter (maths is null) + count(*) filter (science is null) as missing_filled,
           count(*) filter (maths not between 0 and 100) + count(*) filter (science not between 0 and 100)
           + count(*) filter (english not between 0 and 100) as marks_corrected,
           cast(0 as bigint) as attendance_corrected, cast(0 as bigint) as trimmed_records from d
"""
