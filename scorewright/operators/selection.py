"""Exact quantiles of many columns at once by bracket selection: no exploded rows, no sort, no range shuffle.

A first aggregate takes, for every column and group, the count, the ends and two sketched quantiles on either side of
each wanted one. A second aggregate counts the values below and at these brackets and collects only those strictly
inside, a few thousandths of the rows, from which the exact ranks are picked. The brackets are a small table joined by
group (a plain constant without groups), so rows are only ever partially aggregated. Where a bracket could hold more
than ``keep`` values, passes narrow it first: the values inside are counted and sketched by 64ths, and the 64ths around
the rank become the new bracket. A sketch that missed its rank is found by the exact counts, and its bracket is widened
to the ends of the data and narrowed again.

Nulls and NaN are left out. A group without values gets nulls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions.names import ref
from scorewright.session import materialise

KEEP = 100_000
SKETCH = 1_000  # ranks are off by a thousandth at most
SMALL = 2_000  # groups up to this size are collected whole
_PARTS = 64
_PASSES = 40  # each leaves a thirtieth of the values, or ties alone


def _value(column: str) -> Column:
    x = ref(column).cast("double")
    return F.when(~F.isnan(x), x)


def _rank(n: Column, p: float, bound) -> Column:
    return bound((n - 1) * F.lit(float(p))).cast("long")


class _Targets:
    """The wanted quantiles: number, column, probability."""

    def __init__(self, columns: list[str], probabilities: list[float], by: list[str]):
        self.columns, self.by = columns, by
        self.every = [(t, i, p) for t, (i, p) in enumerate((i, p) for i in range(len(columns)) for p in probabilities)]

    def ends(self, df: DataFrame, small: int) -> DataFrame:
        """Per group: n, least and greatest of each column, and the first brackets."""
        groups = [ref(c) for c in self.by]
        cells = []
        for i, c in enumerate(self.columns):
            v = _value(c)
            marks = [x for t, j, p in self.every if j == i for x in (max(0.0, p - 2 / SKETCH), min(1.0, p + 2 / SKETCH))]
            cells += [F.count(v).alias(f"_n{i}"), F.min(v).alias(f"_min{i}"), F.max(v).alias(f"_max{i}"),
                      F.percentile_approx(v, marks, SKETCH).alias(f"_marks{i}")]
        rows = df.groupBy(*groups).agg(*cells)
        at = {i: 0 for i in range(len(self.columns))}
        brackets = []
        for t, i, _ in self.every:
            whole = F.col(f"_n{i}") <= small
            brackets += [F.when(whole, F.col(f"_min{i}")).otherwise(F.col(f"_marks{i}")[at[i]]).alias(f"_lo{t}"),
                         F.when(whole, F.col(f"_max{i}")).otherwise(F.col(f"_marks{i}")[at[i] + 1]).alias(f"_hi{t}")]
            at[i] += 2
        kept = [f"_{k}{i}" for i in range(len(self.columns)) for k in ("n", "min", "max")]
        return rows.select(*[ref(c) for c in self.by], *kept, *brackets)

    def _met(self, df: DataFrame, state: DataFrame) -> DataFrame:
        """The rows beside the brackets of their group."""
        keys = [f"_key{k}" for k in range(len(self.by))]
        slim = df.select(*[ref(c).alias(k) for c, k in zip(self.by, keys)], *[_value(c).alias(f"_v{i}") for i, c in enumerate(self.columns)])
        lows = [f"_{side}{t}" for t, _, _ in self.every for side in ("lo", "hi")]
        if not self.by:
            row = state.select(*lows).first()  # one row
            return slim.withColumns({c: F.lit(row[c]).cast("double") for c in lows})
        other = state.select(*[ref(c).alias(f"_of{k}") for k, c in enumerate(self.by)], *lows)
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(keys)])
        return slim.join(other, same).drop(*[f"_of{k}" for k in range(len(self.by))])

    def _sides(self, t: int, i: int) -> tuple[list[Column], Column]:
        v, lo, hi = F.col(f"_v{i}"), F.col(f"_lo{t}"), F.col(f"_hi{t}")
        inside = F.when((v > lo) & (v < hi), v)
        counts = [F.count_if(v < lo).alias(f"_below{t}"), F.count_if(v == lo).alias(f"_atlo{t}"),
                  F.count_if((v == hi) & (hi > lo)).alias(f"_athi{t}")]
        return counts, inside

    def _grouped(self, df: DataFrame, state: DataFrame, cells: list[Column]) -> DataFrame:
        keys = [F.col(f"_key{k}") for k in range(len(self.by))]
        found = self._met(df, state).groupBy(*keys).agg(*cells)
        if not self.by:
            return state.crossJoin(found)  # one row each
        same = reduce(lambda a, b: a & b, [ref(c).eqNullSafe(F.col(f"_key{k}")) for k, c in enumerate(self.by)])
        return state.join(found, same).drop(*[f"_key{k}" for k in range(len(self.by))])

    def narrowed(self, df: DataFrame, state: DataFrame, keep: int) -> tuple[DataFrame, bool]:
        """The next brackets, and whether each holds ``keep`` values at most and its ranks."""
        cells = []
        for t, i, _ in self.every:
            counts, inside = self._sides(t, i)
            marks = [k / _PARTS for k in range(_PARTS + 1)]
            cells += [*counts, F.count(inside).alias(f"_in{t}"), F.percentile_approx(inside, marks, SKETCH).alias(f"_parts{t}")]
        counted = materialise(self._grouped(df, state, cells), "brackets")
        new, done = [], []
        for t, i, p in self.every:
            n, inner = F.col(f"_n{i}"), F.col(f"_in{t}")
            upto = F.col(f"_below{t}") + F.col(f"_atlo{t}")
            first, last = _rank(n, p, F.floor), _rank(n, p, F.ceil)
            missed = (first < F.col(f"_below{t}")) | (last >= upto + inner + F.col(f"_athi{t}"))
            a = F.floor((first - upto) * _PARTS / inner).cast("int") - 1
            b = F.ceil((last - upto + 1) * _PARTS / inner).cast("int") + 1
            wide = inner > keep
            lo = F.when(missed, F.col(f"_min{i}")).when(wide & (first >= upto) & (a > 0), F.get(F.col(f"_parts{t}"), a)).otherwise(F.col(f"_lo{t}"))
            hi = (F.when(missed, F.col(f"_max{i}")).when(wide & (last < upto), F.get(F.col(f"_parts{t}"), F.lit(1)))
                  .when(wide & (b < _PARTS), F.get(F.col(f"_parts{t}"), b)).otherwise(F.col(f"_hi{t}")))
            # ranks on the lower end alone need nothing inside
            lo = F.when(wide & ~missed & (first >= upto + inner), F.get(F.col(f"_parts{t}"), F.lit(_PARTS - 1))).otherwise(lo)
            new += [lo.alias(f"_lo{t}"), hi.alias(f"_hi{t}")]
            done.append((n == 0) | ~missed & ~wide)
        kept = [*[ref(c) for c in self.by], *[f"_{k}{i}" for i in range(len(self.columns)) for k in ("n", "min", "max")]]
        every = reduce(lambda x, y: x & y, done)
        open_ = not counted.where(~every).isEmpty()
        if not open_:
            return state, True
        return materialise(counted.select(*kept, *new), "brackets"), False

    def picked(self, df: DataFrame, state: DataFrame) -> DataFrame:
        """Per group n and the wanted values; null where a bracket misses its rank."""
        cells = []
        for t, i, _ in self.every:
            counts, inside = self._sides(t, i)
            cells += [*counts, F.sort_array(F.collect_list(inside)).alias(f"_inside{t}")]
        rows = self._grouped(df, state, cells)

        def at(t: int, i: int, rank: Column) -> Column:
            below, inside = F.col(f"_below{t}"), F.col(f"_inside{t}")
            upto = below + F.col(f"_atlo{t}")
            return (F.when(rank < below, None).when(rank < upto, F.col(f"_lo{t}"))
                    .when(rank < upto + F.size(inside), F.get(inside, (rank - upto).cast("int")))
                    .when(rank < upto + F.size(inside) + F.col(f"_athi{t}"), F.col(f"_hi{t}")))

        out = [F.col(f"_n{i}").alias(f"n{i}") for i in range(len(self.columns))]
        for t, i, p in self.every:
            n = F.col(f"_n{i}")
            low, high = at(t, i, _rank(n, p, F.floor)), at(t, i, _rank(n, p, F.ceil))
            share = (n - 1) * F.lit(float(p)) - F.floor((n - 1) * F.lit(float(p)))
            out.append((low + (high - low) * share).alias(f"q{t}"))
        return rows.select(*[ref(c) for c in self.by], *out)


def wide_quantiles(df: DataFrame, columns: list[str], probabilities: list[float] = (0.5,), by: list[str] = (), *,
                   keep: int = KEEP, small: int = SMALL) -> DataFrame:
    """Per group: ``n0, n1, ...`` counts of the columns, and ``q0, q1, ...``, linearly interpolated quantiles, of the
    first column in order of ``probabilities``, then of the second, and so on.

    ``df`` is read twice, so pass a stored table when its plan is costly.
    """
    targets = _Targets(list(columns), [float(p) for p in probabilities], list(by))
    state = materialise(targets.ends(df, small), "brackets")
    counts = [F.col(f"_n{i}") for i in range(len(columns))]
    largest = state.agg(F.max(F.greatest(*counts) if len(counts) > 1 else counts[0])).first()[0] or 0
    if largest * 6 / SKETCH <= keep or largest <= min(small, keep):
        found = materialise(targets.picked(df, state), "quantiles")
        missed = reduce(lambda a, b: a | b, [(F.col(f"n{i}") > 0) & F.col(f"q{t}").isNull() for t, i, _ in targets.every])
        if found.where(missed).isEmpty():
            return found
    for _ in range(_PASSES):
        state, done = targets.narrowed(df, state, keep)
        if done:
            break
    return materialise(targets.picked(df, state), "quantiles")
