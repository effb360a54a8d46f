"""Small helpers shared by the text operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HELD_OUT_FOLDS = 5


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(column: str = "doc_id") -> Column:
    """True for the rows no label may be learned from: crc32 of the id as text leaves no remainder by five.

    A null id counts as held out, so that nothing is learned from it.
    """
    return F.coalesce(F.crc32(F.col(column).cast("string")) % HELD_OUT_FOLDS == 0, F.lit(True))


def tasks(spark: SparkSession) -> int:
    """The partition count the session asks for; the size of a task is set there."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def prefix_sums(totals: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """``key`` and the sum of ``value`` over all smaller keys; one row per task of the job before, so one window."""
    from pyspark.sql import Window

    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = totals.groupBy(key).agg(F.sum(value).alias(value))
    return summed.select(key, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long").alias(into))


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about ``chars`` bytes of ``column``, or one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = total = 0
        for at, size in enumerate(sizes):
            if total and total + size > chars:
                yield batch.slice(begin, at - begin)
                begin, total = at, 0
            total += size
        if begin < len(sizes):
            yield batch.slice(begin)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0
