"""Every registered query: equal to its SQL, or at least rows of a stable schema."""

import pytest

import __spark_entry__ as driver
from scorewright import workload
from tests.oracle import compare

HEAVY = {"kmeans_select_k", "segment_entities", "train_models", "feature_importance"}  # see test_models


def test_registry():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(workload.QUERIES) <= set(driver.queries())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["department", "avg_gpa", "avg_attendance", "student_count", "dept_rank"]
    assert df.count() > 0


@pytest.mark.parametrize("name", [n for n in workload.QUERIES if n not in HEAVY])
def test_query(spark, duck, sf_dir, name):
    assert compare(spark, duck, name, sf_dir) == []
