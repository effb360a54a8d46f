"""Shallot search against plain k-means in whole numbers."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from scorewright.llm import shallot

SCHEMA = "vec_id long, embedding array<float>, label int, v array<long>, cluster int, sums string, distance double, many int"


def plain(rows, many=16, rounds=3, size=64, scale=64):
    kept = [(i, tuple(math.floor(scale * float(np.float32(x))) for x in e)) for i, e in rows
            if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    starts = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in starts[:many]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for i, members in groups.items():
            centroids[i] = tuple(sum(x) // len(members) for x in zip(*members))
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    of = Counter()
    for _, c, d in found:
        of[c] += d
    return Counter((i, c, d, of[c], of.total(), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, [5], 2, "s", .5, 3) for i, e in rows], SCHEMA)


def got(df):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_like_plain_means(spark, spread):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, 64))
    rows = [(i, (middles[i % 30] + spread * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(700)]
    assert got(shallot.assignments(frame(spark, rows).repartition(5))) == plain(rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    grid = [rng.integers(-1, 2, 64).astype(float).tolist() for _ in range(12)]  # many ties
    rows = [(i, grid[i % 12]) for i in range(40)] + [(3, grid[5]), (3, grid[5]), (None, grid[1]), (None, grid[2])]
    rows += [(90, None), (91, []), (92, [0.5] * 63), (93, [0.5] * 65), (94, [None, *[0.5] * 63]), (95, [math.nan, *[0.5] * 63]),
             (96, [math.inf, *[0.5] * 63])]
    assert got(shallot.assignments(frame(spark, rows))) == plain(rows)
    few = rows[:3]
    assert got(shallot.assignments(frame(spark, few))) == plain(few)
    one = [(7, [0.5] * 64)] * 3
    assert got(shallot.assignments(frame(spark, one), many=1)) == plain(one, many=1)
    assert shallot.assignments(frame(spark, [])).collect() == []
    assert shallot.assignments(frame(spark, rows[-7:])).collect() == []


def test_bounds_save_distances():
    rng = np.random.default_rng(1)
    middles = rng.integers(-1000, 1000, (16, 64))
    v = middles[rng.integers(0, 16, 4000)] + rng.integers(-9, 10, (4000, 64))
    first = shallot.Search(middles)
    n = len(v)
    state = first.assign(v, np.zeros(n, np.int64), np.ones(n, np.int64), np.full(n, np.inf), np.zeros(n))
    want = ((v[:, None] - middles[None]) ** 2).sum(2).argmin(1)
    assert (state[0] == want).all()
    again = shallot.Search(middles + 1, middles)
    assert (again.assign(v, *state)[0] == ((v[:, None] - middles[None] - 1) ** 2).sum(2).argmin(1)).all()
    assert again.visits == 0 and first.visits < 16 * n


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        shallot.assignments(frame(spark, [(1, [1e9] * 64), (2, [0.0] * 64)])).collect()
