import zipfile

import pytest
from pyspark.sql import functions as F

from scorewright.sources import files, naming, tables


def test_match_columns():
    columns = ["Roll-Number", " NAME ", "Stream", "Attendance (%)", "Internal-1", "Phone", "Study Hours/Week"]
    assert naming.match_columns(columns) == {
        "student_id": "Roll-Number", "student_name": " NAME ", "department": "Stream", "attendance": "Attendance (%)",
        "internal_1": "Internal-1", "study_hours": "Study Hours/Week",
    }
    assert "subject" in naming.unmatched_fields(columns)


def test_first_spelling_then_first_column_wins():
    assert naming.match_columns(["name", "Student Name", "student_name"])["student_name"] == "Student Name"


@pytest.mark.parametrize("mapping", [None, {}, {"subject": ""}, {"subject": "  "}])
def test_mapping_must_not_be_empty(mapping):
    with pytest.raises(ValueError, match="at least one"):
        naming.check_mapping(["a"], mapping)


def test_mapping_names_every_unknown_column():
    with pytest.raises(ValueError, match="'x' .*'y'"):
        naming.check_mapping(["a"], {"subject": "x", "semester": "y", "department": "a"})


def test_file_kind():
    assert files.file_kind("A.CSV") == "csv" and files.file_kind("b.xlsx") == "workbook"
    with pytest.raises(ValueError):
        files.file_kind("c.pdf")


def test_scan_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('name,score,note\n"a, b",1.5,NA\nc,NaN,\nd,oops,x\n')
    typed = files.scan_csv(spark, str(path), "name string, score double, note string")
    assert [tuple(r) for r in typed.collect()] == [("a, b", 1.5, None), ("c", None, None), ("d", None, "x")]
    inferred = files.scan_csv(spark, str(path))
    assert dict(inferred.dtypes)["score"] == "string"  # "oops" is no number
    assert files.preview(inferred, 2).count() == 2


def test_types_are_inferred_without_tokens(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,score,mixed,none,big,a.b\n1,NA,1,NA,9999999999,x\nN/A, 2.5 ,x,,null,1\n3,1e2,2,n/a,7,2\n')
    got = files.scan_csv(spark, str(path))
    assert dict(got.dtypes) == {"id": "bigint", "score": "double", "mixed": "string", "none": "string", "big": "bigint", "a.b": "string"}
    assert [tuple(r) for r in got.collect()] == [
        (1, None, "1", None, 9999999999, "x"), (None, 2.5, "x", None, None, "1"), (3, 100.0, "2", None, 7, "2")]


def _workbook(path, rows_xml, shared):
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
                      'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
                      '<sheet name="Marks" sheetId="1" r:id="rId7"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                      '<Relationship Id="rId7" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                      + "".join(f"<si><t>{t}</t></si>" for t in shared) + "</sst>")
        book.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                      f"<sheetData>{rows_xml}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    header = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
    _workbook(tmp_path / "one.xlsx", header + '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>81.5</v></c></row>'
              '<row r="3"><c r="B3"><v>7</v></c></row>', ["Name", "Score", "Ann"])
    _workbook(tmp_path / "two.xlsx", header + '<row r="2"><c r="A2" t="inlineStr"><is><t>Bob</t></is></c></row>', ["Name", "Score"])
    rows = files.ingest_workbooks(spark, str(tmp_path), "Name string, Score double", sheet="Marks")
    got = sorted((r["file"].rsplit("/", 1)[1], r["row_number"], r["Name"], r["Score"]) for r in rows.collect())
    assert got == [("one.xlsx", 1, "Ann", 81.5), ("one.xlsx", 2, None, 7.0), ("two.xlsx", 1, "Bob", None)]
    assert {r["sheet"] for r in files.list_sheets(spark, str(tmp_path)).collect()} == {"Marks"}


def test_scan_absent_table(spark, tmp_path):
    assert tables.scan_table(spark, f"file:{tmp_path}/none") is None
    assert tables.scan_table(spark, "no_such_table_here") is None


def test_upsert_accumulates_while_replace_does_not(spark, tmp_path):
    one = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, seq int")
    two = spark.createDataFrame([(2, "c", 0), (2, "d", 1), (3, "e", 0)], "k int, v string, seq int")
    first = tables.upsert_latest(None, one, ["k"], ["seq"])
    both = tables.upsert_latest(first, two, ["k"], ["seq"])
    assert {(r["k"], r["v"]) for r in both.collect()} == {(1, "a"), (2, "d"), (3, "e")}
    path = f"file:{tmp_path}/flat"
    tables.replace_table(one, path)
    assert tables.replace_table(two.select("k"), path).count() == 3


def test_status_updates_and_toggle(spark):
    actions = spark.createDataFrame([(1, "PENDING"), (2, "RESOLVED"), (3, "PENDING")], "id int, status string")
    updates = spark.createDataFrame([(1, "COMPLETED", 1), (1, "REJECTED", 2), (3, "BOGUS", 1), (9, "RESOLVED", 1)],
                                    "id int, status string, seq int")
    got = {r["id"]: r["status"] for r in tables.apply_status_updates(actions, updates).collect()}
    assert got == {1: "REJECTED", 2: "RESOLVED", 3: "PENDING"}
    toggled = actions.withColumn("status", tables.toggle_status())
    assert {r["id"]: r["status"] for r in toggled.collect()} == {1: "RESOLVED", 2: "PENDING", 3: "RESOLVED"}


def test_load_counts(spark, tmp_path):
    stored, counts = tables.load_counts({"a": spark.range(5), "b": spark.range(0)}, f"file:{tmp_path}/load")
    assert {r["table_name"]: r["rows_loaded"] for r in counts.collect()} == {"a": 5, "b": 0}
    assert stored["a"].agg(F.sum("id")).first()[0] == 10


def test_harmonise_clashing_types(spark):
    a = spark.createDataFrame([("x", 1.5)], "`Student Name` string, `Internal 1` double")
    b = spark.createDataFrame([("y", "absent")], "name string, `Internal-1` string")
    rows = naming.harmonise({"a": a, "b": b}).orderBy("student_name").collect()
    assert [r.internal_1 for r in rows] == ["1.5", "absent"]


def test_every_missing_token(spark, tmp_path):
    path = tmp_path / "tokens.csv"
    tokens = ["n/a", "#N/A", "#NA", "<NA>", "-nan", "1.#IND", '""', "NULL"]
    path.write_text("k,v\n" + "".join(f"{i},{t}\n" for i, t in enumerate(tokens)))
    assert [r.v for r in files.scan_csv(spark, str(path), "k int, v string").collect()] == [None] * len(tokens)
