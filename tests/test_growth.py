"""What moves over the network grows with the rows, not with the number of passes or variables."""

import re

from scorewright.operators import statistics as S
from scorewright.workload import frames


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _scans(df, column: str) -> int:
    return sum(column in line for line in _plan(df).splitlines() if "Relation" in line)


def test_raw_frame_joins_the_lines_once(spark, sf_dir):
    assert _scans(frames.raw(spark, sf_dir), "l_orderkey") == 1


def test_customers_meet_orders_before_lines(spark, sf_dir):
    lines = _plan(frames.lines(spark, sf_dir)).splitlines()
    depth = {key: next(re.search(r"\w", x).start() for x in lines if "Join" in x and key in x) for key in ("o_custkey", "l_partkey", "l_orderkey")}
    assert depth["l_orderkey"] < min(depth["o_custkey"], depth["l_partkey"])  # the lines move for parts and orders alone


def test_records_by_order_are_dealt_by_order_last(spark, sf_dir):
    first = next(x for x in _plan(frames.order_records(spark, sf_dir)).splitlines() if "Join" in x)
    assert "o_orderkey" in first


def test_quartiles_do_not_repeat_the_plan(spark, monkeypatch):
    df = spark.range(400).selectExpr("id", "id % 100 + 0.0d as v").join(spark.range(400).withColumnRenamed("id", "other"), S.F.expr("id = other"))
    seen, real = [], S.wide_quantiles
    monkeypatch.setattr(S, "wide_quantiles", lambda rows, *a, **k: seen.append(_plan(rows)) or real(rows, *a, **k))
    assert S.iqr_outliers(df.withColumn("v", S.F.expr("if(id = 7, 1e6d, v)")), "v", ["id"]).collect()[0][0] == 7
    assert len(seen) == 1 and "Join" not in seen[0]


def test_spearman_collapses_rows_before_pairs(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 5), float(i % 7), float(i % 3)) for i in range(60)], "a double, b double, y double")
    seen, real = {}, S.materialise
    monkeypatch.setattr(S, "materialise", lambda rows, label="stage": seen.setdefault(label, _plan(rows)) and real(rows, label))
    assert S.correlate_spearman(df, ["a", "b"], "y").count() == 2
    pairs = seen["pairs"]
    assert "Generate" in pairs and pairs.index("Generate") < pairs.index("Aggregate")  # above it
