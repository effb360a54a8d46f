import math

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from scorewright.functions import numbers as N, text as T


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aBcß éÈ9'-_/.,\n", max_size=12), min_size=1, max_size=40))
def test_title_case_is_pythons(spark, values):
    assert column(spark, values, "string", T.title_case) == [v.title() for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.floats(-1000, 1000), st.integers(-4000, 4000).map(lambda k: k / 40)), min_size=1, max_size=60))
def test_one_decimal_is_pythons(spark, values):
    got = column(spark, values, "double", T.one_decimal)
    assert [g.replace("-0.0", "0.0") for g in got] == [f"{v:.1f}".replace("-0.0", "0.0") for v in values]


def test_one_decimal_ties(spark):
    assert column(spark, [64.25, 64.35, 64.75, 0.35], "double", T.one_decimal) == ["64.2", "64.3", "64.8", "0.3"]


def test_parse_number(spark):
    texts = ["12", " 1.5 ", "-.5", "5.", "1e3", "+7", "n/a", "1d", "2f", "0x10", "1_000", "nan", "", "inf", None, "1 2"]
    want = [12.0, 1.5, -0.5, 5.0, 1000.0, 7.0, None, None, None, None, None, None, None, math.inf, None, None]
    assert column(spark, texts, "string", N.parse_number) == want


def test_nan_becomes_null(spark):
    assert column(spark, [1.0, math.nan, None], "double", N.nan_to_null) == [1.0, None, None]


def test_clip_keeps_null(spark):
    assert column(spark, [-1.0, 50.0, 101.0, None], "double", lambda c: N.clip(c, 0, 100)) == [0.0, 50.0, 100.0, None]


def test_clean_text(spark):
    texts = ["  a b\t", "nan", "None", "", "   ", None, "NONE"]
    assert column(spark, texts, "string", T.clean_text) == ["a b", None, None, None, None, None, "NONE"]


def test_keys_and_names(spark):
    assert column(spark, ["Data Structures & Algorithms"], "string", T.derive_key) == ["DATASTRUCT"]
    assert column(spark, ["Data Structures"], "string", T.short_label) == ["DATA STRUC"]
    assert column(spark, ["social_studies_marks"], "string", T.display_name) == ["Social Studies Marks"]


def test_round_even(spark):
    assert column(spark, [0.125, 0.375, 2.5], "double", lambda c: N.round_even(c, 2)) == [0.12, 0.38, 2.5]


def test_mean_of_present(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 4.0)], "a double, b double")
    got = [r[0] for r in df.select(N.mean_of_present([F.col("a"), F.col("b")])).collect()]
    assert got == [1.0, None, 3.0]


def test_strip_is_pythons(spark):
    texts = [" cse ", "　x y ", "\x1cz\x85", "  ", "﻿b"]
    assert column(spark, texts, "string", T.strip) == [t.strip() for t in texts]
