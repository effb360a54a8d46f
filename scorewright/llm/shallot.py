"""Exact k-means by Shallot search over integer vectors.

Every vector remembers its centroid, the second nearest one, an upper bound of its distance to the first and a lower
bound of its distance to all others. Centroids that moved loosen the bounds; only where they no longer decide is the
vector looked at: its distances to both remembered centroids are computed, and the scan starts from the closer one.
The other centroids are visited in order of their distance from that start; one that lies further from the start than
the vector's distance to it plus the second smallest distance so far can be neither nearest nor second, and as the
second smallest distance falls, this ball shrinks and ends the scan. Bounds are floating point and widened; whatever
survives them is compared by exact integer squared distances, of equal ones the smaller number.

A pass is one map over the table of vectors, which writes them with their new bounds and, per task, the sums of each
cluster; only sums of ``k`` clusters reach the driver. Rounds read the table that the one before wrote.

Defined cases: vectors of another length than ``size`` or with null, NaN or infinite components, and null vectors, are
left out. Components are floor(``scale`` * x) and must stay within 2^27, so that squared distances are exact; a larger
one is an error. A null id is never a start unless ids run out, repeated ids are vectors of their own (of equal ones
the least vector starts first). With fewer vectors than ``k`` each starts a cluster. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scorewright.session import materialise

SIZE = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
_WIDE = 1 + 1e-9
_LIMIT = 1 << 27
_STATE = ("sums boolean, vec_id long, v array<long>, cluster int, second int, upper double, lower double, distance long, "
          "many long")
_BATCH = 8_192


def kept_vectors(embeddings: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and the integer components ``v`` of the vectors that take part."""
    whole = F.expr(f"coalesce(size(embedding) = {size} and forall(embedding, x -> x is not null and not isnan(x) "
                   "and abs(x) < double('Infinity')), false)")
    return embeddings.where(whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform(embedding, x -> floor({scale} * double(x)))").alias("v"))


def first_centroids(vectors: DataFrame, many: int = CLUSTERS, seed: int = 1) -> np.ndarray:
    """The vectors of the ``many`` least hashes of ``seed:vec_id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(many).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), -1 if rows else 0)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    gap = v - centroids
    return np.einsum("ij,ij->i", gap, gap)


class Search:
    """Assigns vectors to the nearest of ``centroids``; ``before`` are those that the bounds were made for."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.c, self.k = centroids, len(centroids)
        gaps = np.sqrt(np.array([squared(centroids, row) for row in centroids], np.float64).reshape(self.k, self.k))
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = gaps / _WIDE
        np.fill_diagonal(gaps, np.inf)
        self.half = gaps.min(axis=1, initial=np.inf) / 2 / _WIDE
        moved = np.sqrt(squared(centroids, before).astype(np.float64)) * _WIDE if before is not None else np.zeros(self.k)
        self.moved = moved
        others = [np.delete(moved, i).max(initial=0.0) for i in range(self.k)]
        self.others = np.array(others)
        self.visits = 0  # distances computed, for tests

    def _squared(self, v, at):
        self.visits += len(v)
        return squared(v, self.c[at])

    def assign(self, v: np.ndarray, own, second, upper, lower):
        """New (own, second, upper, lower) of the vectors; those of a first pass have an infinite upper bound."""
        upper = upper + self.moved[own]
        lower = lower - self.others[own]
        if self.k == 1:
            return own, second, np.sqrt(self._squared(v, own).astype(np.float64)) * _WIDE, lower
        own, second = own.copy(), second.copy()
        bar = np.maximum(lower, self.half[own])
        at = np.flatnonzero(upper >= bar)
        near = self._squared(v[at], own[at])
        upper[at] = np.sqrt(near.astype(np.float64)) * _WIDE
        open_ = upper[at] >= bar[at]
        at, near = at[open_], near[open_]
        best, after, far = own[at], second[at], self._squared(v[at], second[at])
        swap = (far < near) | (far == near) & (after < best)
        best, after = np.where(swap, after, best), np.where(swap, best, after)
        near, far = np.where(swap, far, near), np.where(swap, near, far)
        start, reach = best.copy(), np.sqrt(near.astype(np.float64))
        seen = {0: best.copy(), 1: after.copy()}
        for c in np.unique(start):
            rows = np.flatnonzero(start == c)
            for j in self.order[c]:
                if j == c:
                    continue
                rows = rows[self.gaps[c, j] <= (reach[rows] + np.sqrt(far[rows].astype(np.float64))) * _WIDE]
                if not len(rows):
                    break
                new = rows[(seen[0][rows] != j) & (seen[1][rows] != j)]
                d = self._squared(v[at[new]], np.full(len(new), j))
                first = (d < near[new]) | (d == near[new]) & (j < best[new])
                then = ~first & ((d < far[new]) | (d == far[new]) & (j < after[new]))
                up, down = new[first], new[then]
                after[up], far[up] = best[up], near[up]
                best[up], near[up] = j, d[first]
                after[down], far[down] = j, d[then]
        own[at], second[at] = best, after
        upper[at], lower[at] = np.sqrt(near.astype(np.float64)) * _WIDE, np.sqrt(far.astype(np.float64)) / _WIDE
        return own, second, upper, lower


def _rows(batch: pa.RecordBatch, size: int):
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
    if len(v) and max(v.max(), -v.min()) > _LIMIT:
        raise ValueError("a component is too large for exact squared distances")
    return v


def _pass(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None, label: str) -> DataFrame:
    """The vectors assigned anew and the sums of their clusters, written and read back."""
    k, size = centroids.shape
    shared = state.sparkSession.sparkContext.broadcast((centroids, before))  # k vectors

    def run(batches):
        search = Search(*shared.value)
        sums, many = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for begin in range(0, len(batch), _BATCH):
                part = batch.slice(begin, _BATCH)
                v, n = _rows(part, size), len(part)
                own, second, upper, lower = (part.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "second", "upper", "lower"))
                own, second, upper, lower = search.assign(v, own, second, upper, lower)
                np.add.at(sums, own, v)
                many += np.bincount(own, minlength=k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, bool)), part.column("vec_id"), part.column("v"), pa.array(own.astype(np.int32)),
                     pa.array(second.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(squared(v, centroids[own])),
                     pa.nulls(n, pa.int64())],
                    ["sums", "vec_id", "v", "cluster", "second", "upper", "lower", "distance", "many"])
        at = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(at), bool)), pa.nulls(len(at), pa.int64()), pa.array(sums[at].tolist(), pa.list_(pa.int64())),
             pa.array(at.astype(np.int32)), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.float64()),
             pa.nulls(len(at), pa.float64()), pa.nulls(len(at), pa.int64()), pa.array(many[at])],
            ["sums", "vec_id", "v", "cluster", "second", "upper", "lower", "distance", "many"])

    return materialise(state.select("vec_id", "v", "cluster", "second", "upper", "lower").mapInArrow(run, _STATE), label)


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid at the floored mean of its vectors; that of an empty cluster where it was."""
    parts = state.where("sums").select("cluster", "many", F.posexplode("v").alias("place", "x"))
    rows = parts.groupBy("cluster", "place").agg(F.sum("x").alias("x"), F.sum("many").alias("many")).collect()  # k * size
    out = centroids.copy()
    for r in rows:
        out[r.cluster, r.place] = r.x // r.many
    return out


def cluster(embeddings: DataFrame, many: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = 1):
    """Assigned vectors (vec_id, v, cluster, second, distance) as a table, and the final centroids."""
    vectors = kept_vectors(embeddings, size, scale)
    centroids = first_centroids(vectors, many, seed)
    if not len(centroids):
        return None, centroids
    state = vectors.select(
        "*", F.lit(0).alias("cluster"), F.lit(min(1, len(centroids) - 1)).alias("second"),
        F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    before = None
    for r in range(rounds):
        state = _pass(state, centroids, before, f"shallot-{r}")
        before, centroids = centroids, _moved(state, centroids)
        state = state.where("not sums")
    return _pass(state, centroids, before, "shallot").where("not sums"), centroids


_OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def assignments(embeddings: DataFrame, many: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE,
                seed: int = 1) -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = embeddings.sparkSession
    state, centroids = cluster(embeddings, many, rounds, size, scale, seed)
    if state is None:
        return spark.createDataFrame([], _OUT)
    inertia = {r.cluster: r.s for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(r: int) -> str:
    return f"""
a{r} as materialized (select rid, c, d from (select k.rid, c.c,
    list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept k cross join c{r} c)
  qualify row_number() over (partition by rid order by d, c) = 1),
m{r + 1} as (select c, pos, sum(x)::hugeint as s, count(*) as n from (
    select a.c, unnest(k.v) as x, generate_subscripts(k.v, 1) as pos from a{r} a join kept k using (rid)) group by c, pos),
c{r + 1} as materialized (
  select c, list((((s - ((s % n) + n) % n)) // n)::bigint order by pos) as v from m{r + 1} group by c
  union all select c, v from c{r} where c not in (select c from m{r + 1})),"""


ORACLE = f"""
with kept as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
  from embeddings where len(embedding) = {SIZE} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by sha256('1:' || vec_id) nulls last, v) - 1 as c, v from kept
  qualify c < {CLUSTERS}),
{"".join(map(_round_sql, range(ROUNDS)))}
a{ROUNDS} as materialized (select rid, c, d from (select k.rid, c.c,
    list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept k cross join c{ROUNDS} c)
  qualify row_number() over (partition by rid order by d, c) = 1)
select k.vec_id, a.c::integer as cluster, a.d as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia,
  (sum(a.d) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{ROUNDS} a join kept k using (rid) join c{ROUNDS} c using (c)
"""
