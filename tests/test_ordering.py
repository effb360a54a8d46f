"""Bucketed order statistics against brute force, with one group holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest

from scorewright.operators import ordering as O
from scorewright.operators.evaluation import roc_auc, roc_curve
from scorewright.operators.risk import stratified_split
from scorewright.session import materialise

SIZES = [20, 1_000_000]  # rows per bucket: many buckets, and none


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 1500
    group = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcdefgh"), n))
    value = np.where(rng.random(n) < 0.33, 5.0, rng.exponential(10, n).round(2))
    pdf = pd.DataFrame({"id": range(n), "g": group, "v": value, "label": (rng.random(n) < 0.3).astype(int)})
    return pdf, materialise(spark.createDataFrame(pdf).repartition(4))


@pytest.mark.parametrize("size", SIZES)
def test_quantiles(skewed, size):
    pdf, df = skewed
    got = {r["g"]: (r["n"], r["q0"], r["q1"], r["q2"])
           for r in O.exact_quantiles(df, "v", [0.25, 0.5, 0.9], ["g"], rows_per_bucket=size).collect()}
    assert len(got) == pdf["g"].nunique()
    for g, part in pdf.groupby("g"):
        assert got[g][0] == len(part)
        assert got[g][1:] == pytest.approx(part["v"].quantile([0.25, 0.5, 0.9]).tolist())


@pytest.mark.parametrize("size", SIZES)
def test_quantiles_per_measure_scale(spark, size):
    """Measures of very different scale share one table, each cut by its own points."""
    pdf = pd.DataFrame({"m": ["small"] * 300 + ["large"] * 301, "v": list(np.arange(300) / 1000) + list(np.arange(301) * 1e6)})
    counted = materialise(O.value_counts(spark.createDataFrame(pdf), "v", ["m"]))
    rows = O.exact_quantiles(counted, "v", [0.5], ["m"], counted=True, rows_per_bucket=size).collect()
    assert {r["m"]: r["q0"] for r in rows} == pytest.approx(pdf.groupby("m")["v"].median().to_dict())


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None, None)], "g string, v double")
    assert O.exact_quantiles(empty, "v", [0.5], ["g"]).count() == 0


@pytest.mark.parametrize("size", SIZES)
def test_average_ranks(skewed, size):
    pdf, df = skewed
    counted = materialise(O.value_counts(df, "v", ["g"]))
    got = {(r["g"], r["v"]): r["rank"] for r in O.average_ranks(counted, "v", ["g"], rows_per_bucket=size).collect()}
    pdf = pdf.assign(rank=pdf.groupby("g")["v"].rank(method="average"))
    assert got == {(r.g, r.v): r.rank for r in pdf.itertuples()}


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("method, pandas_method", [("rank", "min"), ("dense_rank", "dense"), ("row_number", "first")])
def test_rank_rows(skewed, size, method, pandas_method):
    pdf, df = skewed
    got = {r["id"]: r["place"] for r in O.rank_rows(df, "v", method=method, alias="place", ties=["id"], rows_per_bucket=size).collect()}
    want = pdf["v"].rank(method=pandas_method, ascending=False).astype(int)
    assert got == dict(zip(pdf["id"], want))


def test_rank_rows_nulls_last(spark):
    df = spark.createDataFrame([(1, 3.0), (2, None), (3, 5.0)], "id int, v double")
    for size in (1, 100):
        got = {r["id"]: r["rank"] for r in O.rank_rows(df, "v", rows_per_bucket=size).collect()}
        assert got == {3: 1, 1: 2, 2: 3}


@pytest.mark.parametrize("size", [1, 3, 10**6])
def test_rank_rows_keeps_the_columns_own_order(spark, size):
    big = [2**53 + i for i in range(6)]
    for values, kind in ((big, "long"), ([float("-inf"), None, 1.0, float("-inf")], "double"), (["b", "a", None, "b", "c"], "string")):
        df = spark.createDataFrame(list(enumerate(values)), f"id int, v {kind}")
        for method in ("rank", "dense_rank", "row_number"):
            got = {r["id"]: r["rank"] for r in O.rank_rows(df, "v", method=method, ties=["id"], rows_per_bucket=size).collect()}
            order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] if values[i] is not None else 0)
                           if kind != "string" else (values[i] is not None, values[i] or ""), reverse=True)
            order.sort(key=lambda i: values[i] is None)
            want, distinct = {}, []
            for place, i in enumerate(order, 1):
                if not distinct or distinct[-1][0] != values[i]:
                    distinct.append((values[i], place))
                want[i] = {"rank": distinct[-1][1], "dense_rank": len(distinct)}.get(method)
            if method == "row_number":
                by_value = {}
                for i in order:
                    by_value.setdefault(values[i], []).append(i)
                numbered = [i for v in dict.fromkeys(values[i] for i in order) for i in sorted(by_value[v])]
                want = {i: n for n, i in enumerate(numbered, 1)}
            assert got == want


def test_groups_of_disjoint_ranges_are_split(spark):
    pdf = pd.DataFrame({"g": [i // 100 for i in range(4000)], "v": [float(i) for i in range(4000)]})
    counted = materialise(O.value_counts(spark.createDataFrame(pdf), "v", ["g"]))
    largest = O._ranged(counted, [counted["g"], counted["v"]], 10).groupBy("g", O._BUCKET).count().agg({"count": "max"}).first()[0]
    assert largest <= 30
    got = {r["g"]: r["q0"] for r in O.exact_quantiles(counted, "v", [0.5], ["g"], counted=True, rows_per_bucket=10).collect()}
    assert got == pdf.groupby("g")["v"].median().to_dict()


def test_dense_rank_top_keeps_ties(skewed):
    pdf, df = skewed
    got = {r["id"]: r["rank"] for r in O.dense_rank_top(df, "v", 3).collect()}
    dense = pdf["v"].rank(method="dense", ascending=False).astype(int)
    assert got == {i: d for i, d in zip(pdf["id"], dense) if d <= 3}


def test_top_k(skewed):
    pdf, df = skewed
    best = O.top_k(df, "v", 5, ["id"], alias="place").collect()
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).head(5)
    assert [(r["id"], r["place"]) for r in best] == list(zip(want["id"], range(1, 6)))


def test_first_and_last_per_key(skewed):
    pdf, df = skewed
    ordered = pdf.sort_values("id")
    for pick, want in ((O.first_per_key, ordered.groupby("g").first()), (O.last_per_key, ordered.groupby("g").last())):
        assert {r["g"]: r["v"] for r in pick(df, ["g"], ["id"]).collect()} == want["v"].to_dict()


@pytest.mark.parametrize("size", SIZES)
def test_roc(skewed, size):
    pdf, df = skewed
    points = {r["threshold"]: (r["fpr"], r["tpr"]) for r in roc_curve(df, "label", "v", digits=None, rows_per_bucket=size).collect()}
    pos, neg = pdf[pdf.label == 1]["v"].to_numpy(), pdf[pdf.label == 0]["v"].to_numpy()
    assert points.pop(float("inf")) == (0.0, 0.0)
    assert points.keys() == set(pdf["v"])
    for threshold, (fpr, tpr) in points.items():
        assert (fpr, tpr) == pytest.approx(((neg >= threshold).mean(), (pos >= threshold).mean()))
    area = roc_auc(df, "label", "v", digits=None, rows_per_bucket=size).first()["roc_auc"]
    wins = (pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2
    assert area == pytest.approx(wins)


@pytest.mark.parametrize("size", SIZES)
def test_stratified_split(skewed, size):
    pdf, df = skewed
    split = stratified_split(df, "id", "label", rows_per_bucket=size).toPandas()
    again = stratified_split(df.repartition(7), "id", "label", rows_per_bucket=50).toPandas()
    assert len(split) == len(pdf)
    for label, part in split.groupby("label"):
        assert part["is_test"].sum() == round(0.3 * (pdf.label == label).sum())
    assert set(split[split.is_test]["id"]) == set(again[again.is_test]["id"])


def test_approximate_median(skewed):
    pdf, df = skewed
    got = {r["g"]: r["median"] for r in O.group_median(df, "v", ["g"], exact=False).collect()}
    assert got == pytest.approx(pdf.groupby("g")["v"].median().to_dict(), rel=0.2)
