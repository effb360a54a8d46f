"""Columns by their whole name, dots and all."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
