import pytest

from scorewright.plans.sql import canned_queries, check_read_only, explorer_queries, sql_readonly
from scorewright.session import materialise, release_stages, work_dir


@pytest.mark.parametrize("query", [
    "DROP TABLE x", "select 1; delete from t", "with a as (select 1) insert into t select * from a", "Select replace(a, 'b', 'c') from t",
    "select 'please UPDATE'", "create view v as select 1", "set a=b", "merge into t using u on true when matched then do nothing",
    "add jar x", "", "select java_method('java.lang.System', 'exit', 1)", "truncate table t", "alter table t add column x int",
])
def test_refused(query):
    with pytest.raises(ValueError, match="refused"):
        check_read_only(query)


@pytest.mark.parametrize("query", ["select 1", "  WITH a as (select 1) select * from a;", "values (1)", "(select updated from t)", "select created_at from t"])
def test_allowed(query):
    check_read_only(query)


def test_runs_over_named_tables(spark):
    assert sql_readonly(spark, "select sum(id) as s from numbers;", {"numbers": spark.range(4)}).first()["s"] == 6


@pytest.mark.parametrize("query", ["select * from text.`/etc/hostname`", "with a as (select * from parquet.`/x`) select * from a",
                                   "select * from numbers where id in (select length(value) from csv.`file:///x`)"])
def test_files_are_refused(spark, query):
    with pytest.raises(ValueError, match="refused"):
        sql_readonly(spark, query, {"numbers": spark.range(4)})


@pytest.mark.parametrize("query", [
    "select * from identifier('text.`/etc/hostname`')", "select * from identifier('text' || '.`/etc/hostname`')",
    "select * from numbers where id in (select count(*) from identifier('text.`/etc/hostname`'))",
    "with a as (select * from identifier('text.`/etc/hostname`')) select * from a", "select * from mine", "select * from default.mine",
    "select (select max(id) from mine) as m", "select 1) union (select * from mine",
])
def test_nothing_but_the_given_tables_is_read(spark, query):
    spark.range(3).createOrReplaceTempView("mine")
    with pytest.raises(Exception, match="refused|NOT_FOUND|PARSE_SYNTAX_ERROR"):
        sql_readonly(spark, query, {"numbers": spark.range(4)})


def test_views_of_the_caller_stay(spark):
    spark.range(3).createOrReplaceTempView("students")
    before = len(spark.catalog.listTables())
    got = sql_readonly(spark, "with s as (select id from students where id > 1) select s.id from s join students using (id) order by id desc;  ",
                       {"students": spark.range(40)})
    assert [r.id for r in got.collect()] == list(range(39, 1, -1))
    assert spark.table("students").count() == 3 and len(spark.catalog.listTables()) == before


def test_comments_may_lead(spark):
    query = "-- sum\n/* of all */ select sum(id) as s from default.numbers_in_default"
    check_read_only(query)
    assert sql_readonly(spark, "/* a */ -- b\nselect sum(id) as s from numbers", {"numbers": spark.range(4)}).first()["s"] == 6


def test_ready_made_queries_are_read_only():
    for query in [*canned_queries().values(), *explorer_queries().values()]:
        check_read_only(query)


def test_stages_are_released(spark):
    df = materialise(spark.range(3), "test")
    assert df.count() == 3 and work_dir(spark)
    assert release_stages(spark) >= 1
