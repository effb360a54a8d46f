"""Cleaning on small frames with known answers, and the wide four-row fixture."""

import pytest
from pyspark.sql import functions as F

from scorewright.operators import aggregates as A, cleaning as C, joins as J, profile, quality, star as S
from scorewright.operators.statistics import iqr_outliers
from scorewright.plans.reports import report_dashboard
from scorewright.presets import ACADEMIC_RULES, MeasureRule, Roles

WIDE = [("Alice", 85.0, 90.0, 78.0), ("Bob", 38.0, 42.0, 35.0), ("Charlie", 92.0, 88.0, 95.0), ("David", 45.0, 52.0, 48.0)]
MARKS = ["maths_marks", "science_marks", "english_marks"]


@pytest.fixture(scope="module")
def wide(spark):
    df = spark.createDataFrame(WIDE, "student_name string, maths_marks double, science_marks double, english_marks double")
    return C.clean_records(df, {"student_name": "student_name"})


def test_wide_index_and_trend(wide):
    rows = {r["student_name"]: r for r in wide.collect()}
    assert {n: r["performance_index"] for n, r in rows.items()} == {"Alice": 84.33, "Bob": 38.33, "Charlie": 91.67, "David": 48.33}
    assert {r["current_gpa"] for r in rows.values()} == {8.43, 3.83, 9.17, 4.83}
    assert {(r["performance_change"], r["performance_trend"]) for r in rows.values()} == {(0.0, "STABLE")}


def test_wide_dashboard(wide):
    cards = report_dashboard(wide, Roles(), measures=MARKS)
    subjects = {r["subject_id"]: r for r in cards["subjects"].collect()}
    assert {k: (r["total_students"], r["passed_students"], r["pass_rate"], r["fail_rate"], r["avg_score"]) for k, r in subjects.items()} == {
        "MATHS_MARK": (4, 3, 75.0, 25.0, 65.0), "SCIENCE_MA": (4, 4, 100.0, 0.0, 68.0), "ENGLISH_MA": (4, 3, 75.0, 25.0, 64.0),
    }
    assert subjects["MATHS_MARK"]["subject_name"] == "Maths Marks"
    assert [r["student_id"] for r in cards["top_students"].orderBy("rnk").limit(3).collect()] == ["Charlie", "Alice", "David"]
    assert "departments" not in cards
    assert cards["summary"].first()["total_students"] == 4


def test_wide_has_no_outliers(wide):
    assert iqr_outliers(wide, "performance_index").count() == 0
    assert iqr_outliers(wide.limit(3), "performance_index").count() == 0


def test_wide_capabilities(wide):
    caps = profile.capabilities(wide).first()
    assert caps["layout"] == "wide" and caps["wide_measures"] == MARKS
    assert caps["entity_reports"] and caps["subject_reports"] and not caps["attendance_reports"]


@pytest.fixture(scope="module")
def dirty(spark):
    rows = [
        ("S1", " Ann ", "maths", "90", 20.0, 25.0, 50.0),
        ("S1", " Ann ", "maths", "90", 20.0, 25.0, 50.0),  # copy
        ("S2", "Bob", "MATHS ", "112.5", 45.0, None, 60.0),  # out of range, missing
        ("S3", "None", "maths", "n/a", 10.0, 15.0, 125.0),
        ("S4", "Dee", "art", None, -2.5, 5.0, None),
        ("S5", "Eve", None, "40", 6.0, 7.0, 30.0),
        (None, None, None, None, None, None, None),
        (None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "USN string, Name string, Course string, Att string, `Internal 1` double, Int2 double, Exam double")


MAPPING = {"student_id": "USN", "student_name": "Name", "subject": "Course", "attendance": "Att", "internal_1": "Internal 1",
           "internal_2": "Int2", "final_exam": "Exam"}


def test_quality_report(dirty):
    ranges = {"attendance": [MeasureRule("Att", 100.0, 0.0)], "marks": [MeasureRule("Internal 1", 30.0, 0.0), MeasureRule("Exam", 100.0, 0.0)]}
    r = quality.quality_report(dirty, ranges).first()
    assert (r["total_rows"], r["total_columns"], r["duplicates"], r["missing_count"]) == (8, 7, 2, 18)
    assert (r["invalid_marks"], r["invalid_attendance"], r["empty_columns"]) == (3, 1, 0)
    assert [r[f"{k}_status"] for k in ("missing", "duplicates", "marks", "attendance", "overall")] == [
        "CRITICAL", "WARNING", "WARNING", "WARNING", "CRITICAL"]


def test_quality_of_an_empty_table(spark):
    r = quality.quality_report(spark.createDataFrame([], "a int, b string"), {}).first()
    assert (r["total_rows"], r["missing_percentage"], r["overall_status"]) == (0, 0.0, "GOOD")


def test_cleaning_audit(dirty):
    r = C.cleaning_audit(dirty, MAPPING).first()
    # attendance: one missing and one text counted twice; internal_2 and exam one missing each
    assert r.asDict() == {"duplicates_removed": 1, "missing_filled": 5, "marks_corrected": 3, "attendance_corrected": 1, "trimmed_records": 2}


def test_clean_records(dirty):
    rows = {r["student_id"]: r for r in C.clean_records(dirty, MAPPING).collect()}
    assert set(rows) == {"S1", "S2", "S3", "S4", "S5"}
    assert {r["subject"] for r in rows.values()} == {"Maths", "Art", None}
    assert rows["S1"]["student_name"] == "Ann" and rows["S3"]["student_name"] is None
    # group median of maths (90, 100 after clipping); overall median of (90, 100, 40) for art
    assert (rows["S2"]["attendance"], rows["S3"]["attendance"], rows["S4"]["attendance"]) == (100.0, 95.0, 90.0)
    assert rows["S2"]["internal_1"] == 30.0 and rows["S4"]["internal_1"] == 0.0
    assert rows["S2"]["internal_2"] == 20.0  # median of 25 and 15
    assert rows["S3"]["final_exam"] == 100.0 and rows["S4"]["final_exam"] == 55.0  # overall median of 30, 50, 60, 100
    # weights .3 and .4 of the parts present, rescaled
    assert rows["S1"]["performance_index"] == pytest.approx((75 * 0.3 + 50 * 0.4) / 0.7, abs=0.005)
    assert rows["S1"]["performance_change"] == 0.0


def test_all_missing_measure_takes_its_fallback(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", None, 2.0)], "subject string, attendance double, final_exam double")
    filled = C.impute_group_median(df, ACADEMIC_RULES, "subject")
    assert [r["attendance"] for r in filled.collect()] == [85.0, 85.0]


def test_index_needs_exam_or_first_internal(spark):
    df = spark.createDataFrame([("a", 10.0)], "subject string, quiz_score double")
    assert "performance_index" not in C.clean_records(df, {"subject": "subject", "quiz_score": "quiz_score"}).columns


def test_trend_labels(spark):
    df = spark.createDataFrame([(8.0, 7.5), (7.0, 7.3), (6.0, 7.0), (None, 1.0)], "current_gpa double, previous_gpa double")
    labelled = C.trend_label(C.score_change(df))
    assert [r["performance_trend"] for r in labelled.collect()] == ["IMPROVING", "STABLE", "DECLINING", "STABLE"]


RECORDS = [
    ("S1", "Ann", "CS", 1, "2025", "Data Structures One", 7.0, 80.0, 1),
    ("S2", "Bob", "EE", 2, "2025", "Data Structures Two", 6.0, 70.0, 2),
    ("S1", "Anna", "EE", 1, "2025", "Data Structures One", 8.0, 90.0, 3),
]


@pytest.fixture(scope="module")
def star(spark):
    df = spark.createDataFrame(RECORDS, "student_id string, student_name string, department string, semester int, academic_year string, "
                               "subject string, previous_gpa double, attendance double, seq int")
    return df, S.split_star(df, ["seq"])


def test_split_star(star):
    df, tables = star
    assert {(r["student_id"], r["student_name"], r["previous_gpa"]) for r in tables["students"].collect()} == {("S1", "Ann", 7.0), ("S2", "Bob", 6.0)}
    # both names share a key: the (name, department) pair seen last wins
    assert [tuple(r) for r in tables["subjects"].collect()] == [("DATASTRUCT", "Data Structures One", "EE")]
    assert {(r["student_id"], r["attendance_pct"]) for r in tables["attendance"].collect()} == {("S1", 90.0), ("S2", 70.0)}
    assert {r["performance_trend"] for r in tables["student_performance"].collect()} == {"STABLE"}
    assert {(r["study_hours"], r["lms_activity"]) for r in tables["learning_behavior"].collect()} == {(0.0, 0)}
    assert S.key_collisions(df).first().asDict() == {"derived_key": "DATASTRUCT", "names": 2}
    assert S.check_constraints(tables).where("violations > 0").count() == 0


def test_split_star_needs_its_columns(star):
    with pytest.raises(ValueError, match="semester"):
        S.split_star(star[0].drop("semester"), ["seq"])


def test_constraints_and_quarantine(star):
    _, tables = star
    bad = tables["attendance"].withColumn("student_id", F.when(F.col("student_id") == "S2", "S9").otherwise(F.col("student_id"))).withColumn(
        "attendance_pct", F.col("attendance_pct") + 20)
    report = S.check_constraints({**tables, "attendance": bad}).where("violations > 0")
    assert {(r["table_name"], r["rule"], r["violations"]) for r in report.collect()} == {("attendance", "range", 1), ("attendance", "foreign_key", 1)}
    good, quarantined = S.split_valid(bad, S.STAR_RULES["attendance"], tables)
    assert (good.count(), quarantined.count()) == (0, 2)


def test_repeated_and_null_keys_are_quarantined(spark):
    rows = [("a", "x", 5.0), ("a", "x", 6.0), (None, "x", 7.0), (None, "x", 7.0), ("b", "y", 101.0), ("c", "x", None), ("d", None, 1.0)]
    facts = spark.createDataFrame(rows, "student_id string, subject_id string, attendance_pct double")
    tables = {"students": spark.createDataFrame([("a",), ("c",), ("d",)], "student_id string"),
              "subjects": spark.createDataFrame([("x",)], "subject_id string")}
    got = S.judged(facts, S.STAR_RULES["attendance"], tables).collect()
    assert sorted((str(r["student_id"]), str(r["attendance_pct"]), r["reasons"]) for r in got) == sorted([
        ("a", "5.0", ["unique:student_id,subject_id"]), ("a", "6.0", ["unique:student_id,subject_id"]),
        ("None", "7.0", ["not_null:student_id"]), ("None", "7.0", ["not_null:student_id"]),
        ("b", "101.0", ["range:attendance_pct", "foreign_key:student_id->students", "foreign_key:subject_id->subjects"]),
        ("c", "None", []), ("d", "1.0", ["not_null:subject_id"])])
    good, bad = S.split_valid(facts, S.STAR_RULES["attendance"], tables)
    assert [tuple(r) for r in good.collect()] == [("c", "x", None)] and bad.count() == 6 and bad.columns == facts.columns
    none = facts.limit(0)
    report = S.check_constraints({"attendance": none, **tables}, {**S.STAR_RULES, "students": S.TableRules(("student_id",)), "subjects": S.TableRules(("subject_id",))})
    assert report.where("table_name = 'attendance'").count() == 6 and report.where("violations > 0").count() == 0


def test_lookup_defaults(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "student_id string")
    details = spark.createDataFrame([("a", "Second", 2), ("a", "First", 1)], "student_id string, student_name string, seq int")
    defaults = {"student_name": F.col("student_id"), "department": F.lit("All")}
    got = J.join_lookup_default(rows, details, "student_id", defaults, ["seq"])
    assert {tuple(r) for r in got.select("student_id", "student_name", "department").collect()} == {("a", "First", "All"), ("b", "b", "All")}


def test_pass_fail_counts_unscored_rows(spark):
    df = spark.createDataFrame([("m", 50.0), ("m", None), ("e", None), (None, 90.0)], "subject string, score double")
    got = {r["subject_name"]: (r["total_students"], r["passed_students"], r["pass_rate"], r["fail_rate"]) for r in A.pass_fail_long(df, "subject", "score").collect()}
    assert got == {"m": (2, 1, 50.0, 50.0), "e": (1, 0, 0.0, 0.0)}
    nothing = A.pass_fail_long(df, "subject", None).collect()
    assert {r["avg_score"] for r in nothing} == {0.0}


def test_mode_and_first_present(spark):
    df = spark.createDataFrame([(1, "b", None, 1), (1, "a", "x", 2), (1, "b", "y", 3), (2, "d", "z", 4), (2, "c", None, 5)], "e int, label string, attr string, seq int")
    rolled = A.entity_rollup(df, "e", [], ["attr"], "label", order=["seq"])
    assert {tuple(r) for r in rolled.select("e", "attr", "label").collect()} == {(1, "x", "b"), (2, "z", "c")}


def test_indicators_with_absent_columns(spark):
    df = spark.createDataFrame([("a", 70.0, 10.0), ("a", 75.0, 20.0)], "student_id string, attendance double, internal_1 double")
    r = A.indicator_flags(A.entity_indicators(df, "student_id")).first()
    assert (r["attendance_avg"], r["internals_avg"], r["study_hours"]) == (72.5, 7.5, 0.0)
    assert r["attendance_avg_low"] and r["internals_avg_low"] and r["study_hours_low"]


def test_filter_facets(spark):
    df = spark.createDataFrame([("a", "Ann", "HIGH"), ("b", "Bob", "LOW")], "id string, name string, level string")
    assert A.filter_facets(df, {"level": "ALL"}, "AN", ["name", "id"]).count() == 1
    assert A.filter_facets(df, {"level": "HIGH"}, "", ["name"]).first()["id"] == "a"


def test_points_need_two_columns(spark):
    with pytest.raises(ValueError):
        A.project_points(spark.range(1), ["id", "absent"])
