import math

import numpy as np
import pytest

from scorewright.operators import statistics as S


def test_histogram_matches_numpy(spark):
    values = np.round(np.random.default_rng(3).normal(50, 12, 800), 1)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    rows = S.histogram(df, ["v"], digits=None).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=10)
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r["bin_from"] for r in rows] + [rows[-1]["bin_to"]] == pytest.approx(edges.tolist())


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(4.0,), (4.0,), (None,)], "v double")
    rows = S.histogram(df, ["v"]).orderBy("bin").collect()
    counts, edges = np.histogram([4.0, 4.0], bins=10)
    assert [r["count"] for r in rows] == counts.tolist() and rows[0]["bin_from"] == edges[0]


@pytest.mark.parametrize("t, dof, p", [
    (2.0, 10, 0.07338803477074037), (0.0, 5, 1.0), (12.706204736432095, 1, 0.05), (1.959963984540054, 1e9, 0.05000000027729),
    (3.169272672616872, 10, 0.01), (math.inf, 3, 0.0), (1.0, 1, 0.5),
])
def test_p_value(t, dof, p):
    assert S.two_sided_p([t], [dof])[0] == pytest.approx(p, rel=1e-9)


@pytest.mark.parametrize("dof", [5, 10**3, 10**6, 10**8, 10**10])
def test_p_value_has_one_formula(dof):
    """Against the expansion around the normal tail, whose terms vanish with the degrees of freedom."""
    for t in (0.001, 1.0, 5.0, 20.0):
        got = S.two_sided_p([t], [dof])[0]
        if dof < 100:  # the finite series of odd degrees of freedom
            u, c = math.atan2(t, math.sqrt(dof)), math.cos(math.atan2(t, math.sqrt(dof)))
            want = 1 - 2 / math.pi * (u + math.sin(u) * (c + 2 / 3 * c**3))
            assert got == pytest.approx(want, abs=1e-12)
        else:
            a = dof - 0.5
            z = math.sqrt(a * math.log1p(t * t / dof))
            z += (z**3 + 3 * z - (4 * z**7 + 33 * z**5 + 240 * z**3 + 855 * z) / (480 * a * a + 8 * z**4 * 10 + 1000)) / (48 * a * a)
            assert got == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6)
    assert math.isnan(S.two_sided_p([math.nan], [dof])[0])


def test_pearson_and_spearman(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, 400).astype(float)
    y = x * 2 + rng.normal(0, 9, 400).round(0)
    df = spark.createDataFrame([(float(a), float(b), 1.0, None) for a, b in zip(x, y)], "x double, y double, c double, e double")
    r = S.correlate_pearson(df, ["x", "c", "e"], "y").collect()
    assert [row["variable"] for row in r] == ["x"]  # constant and empty columns give no row
    assert r[0]["pearson_coef"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    import pandas as pd

    rho = S.correlate_spearman(df, ["x", "c", "e"], "y").collect()
    assert [row["variable"] for row in rho] == ["x"]
    assert rho[0]["spearman_coef"] == pytest.approx(np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1])


def test_perfect_and_too_few(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)], "x double, y double")
    row = S.correlate_pearson(df, ["x"], "y").withColumn("p", S.t_test_p("pearson_t", "n")).first()
    assert (row["n"], row["pearson_coef"]) == (5, pytest.approx(1.0)) and row["p"] < 1e-8
    assert S.correlate_pearson(df.limit(4), ["x"], "y").count() == 0


def test_classification(spark):
    rows = [("a_b", 0.9, 0.01), ("c", 0.5, 0.01), ("d", -0.9, 0.001), ("e", 0.9, 0.2)]
    got = S.classify_correlation(spark.createDataFrame(rows, "variable string, pearson_coef double, pearson_p_value double")).collect()
    assert [r["interpretation"] for r in got] == ["Strong positive linear correlation", "Moderate positive correlation",
                                                  "Weak correlation", "No statistically significant correlation"]
    assert got[0]["hypothesis_summary"] == (
        "Null Hypothesis (H0): There is no correlation between a b and student GPA.\n"
        "Alternative Hypothesis (Ha): There is a statistically significant correlation.\n"
        "Decision: Reject H0 (p-value = 1.00e-02).")
    assert not got[3]["significant"]


def test_correlation_report(spark):
    df = spark.createDataFrame([(float(i), float(i * i), float(-i)) for i in range(30)], "attendance double, current_gpa double, study_hours double")
    rows = {r["variable"]: r for r in S.correlation_tests(df, "current_gpa").collect()}
    assert set(rows) == {"attendance_pct", "study_hours"}
    assert rows["attendance_pct"]["spearman_coef"] == 1.0 and rows["study_hours"]["spearman_coef"] == -1.0
    assert rows["attendance_pct"]["label"] == "Attendance vs GPA"
