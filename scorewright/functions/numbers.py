"""Numeric column expressions with one null policy: NaN never survives ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F, types as T

# Fixed value: the texts accepted as numbers (blank-padded, signed, decimal,
# exponent, infinity). A bare cast would also take suffixes such as "1d".
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def parse_number(value: Column, data_type: T.DataType | None = None) -> Column:
    """Double of ``value``, or null where it is no number.

    Pass the column's type to skip the text test for columns already numeric.
    """
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return nan_to_null(value.cast("double"))
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    text = value.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def clip(value: Column, low: float, high: float) -> Column:
    """``value`` held inside [low, high]; null stays null."""
    return F.when(value < low, F.lit(float(low))).when(value > high, F.lit(float(high))).otherwise(value)


def outside(value: Column, low: float, high: float) -> Column:
    """True where ``value`` is present and outside [low, high]."""
    return F.coalesce((value < low) | (value > high), F.lit(False))


def round_even(value: Column, digits: int | None) -> Column:
    """Round half to even in binary floating point, as array libraries do."""
    if digits is None:
        return value
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def mean_of_present(columns: list[Column]) -> Column:
    """Row mean over the non-null columns; null when none is present."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    present = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in columns])
    return F.try_divide(total, present.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100.0
