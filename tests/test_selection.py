"""Bracket selection against plain quantiles."""

import math
import random

import numpy as np
import pytest

from scorewright.operators import selection
from scorewright.operators.selection import wide_quantiles

PROBABILITIES = [0.0, 0.25, 0.5, 0.9, 1.0]


def rows_of(many, seed, groups=4):
    rng = random.Random(seed)
    out = []
    for _ in range(many):
        grp = rng.choice([*range(groups), None, 0, 0])
        x = rng.choice([rng.gauss(0, 1), float(rng.randint(0, 3)), None, float("nan"), 7.5])
        out.append((grp, x, None if grp == 1 else rng.randint(-10 ** 15, 10 ** 15), rng.choice([1, 1, 1, 2])))
    return out


def plain(rows, by):
    groups = {}
    for r in rows:
        groups.setdefault(r[0] if by else None, []).append(r)
    out = {}
    for g, members in groups.items():
        cells = []
        for c in (1, 2, 3):
            v = [float(m[c]) for m in members if m[c] is not None and not (isinstance(m[c], float) and math.isnan(m[c]))]
            cells.append((len(v), [float(np.quantile(v, p)) if v else None for p in PROBABILITIES]))
        out[g] = cells
    return out


@pytest.mark.parametrize("by", [[], ["grp"]])
@pytest.mark.parametrize("many, keep, small", [(0, 100, 10), (1, 100, 10), (37, 100, 10), (4000, 100_000, 10), (4000, 30, 10), (4000, 3000, 2000)])
def test_like_plain_quantiles(spark, by, many, keep, small):
    rows = rows_of(many, many + keep)
    df = spark.createDataFrame(rows, "grp int, `x.1` double, big long, tie int").repartition(3)
    got = wide_quantiles(df, ["x.1", "big", "tie"], PROBABILITIES, by, keep=keep, small=small).collect()
    want = plain(rows, by) if rows or by else {None: [(0, [None] * 5)] * 3}
    assert len(got) == len(want)
    for r in got:
        cells = want[r.grp if by else None]
        for i, (n, q) in enumerate(cells):
            assert r[f"n{i}"] == n
            for j, x in enumerate(q):
                y = r[f"q{5 * i + j}"]
                assert (x is None) == (y is None) and (x is None or abs(x - y) <= 1e-9 * max(1, abs(x)))


def test_a_missed_rank_is_found(spark, monkeypatch):
    """Brackets that lie elsewhere are widened and narrowed to the exact rank."""
    real = selection._Targets.ends
    off = lambda self, df, small: real(self, df, small).withColumns({"_lo0": selection.F.lit(-5.0), "_hi0": selection.F.lit(-4.0)})
    monkeypatch.setattr(selection._Targets, "ends", off)
    df = spark.range(1001).selectExpr("cast(id * id as double) as x")
    assert wide_quantiles(df, ["x"], keep=50, small=5).first().q0 == 250_000.0


def test_no_row_is_exploded(spark):
    df = spark.range(10_000).selectExpr("id % 7 as grp", "id as x", "id * 2 as y")
    targets = selection._Targets(["x", "y"], [0.5], ["grp"])
    plan = targets.picked(df, targets.ends(df, 10))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan and "rangepartitioning" not in plan
