"""Harmonising differently named sources: header matching, mapping, coverage."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from scorewright.presets import ACADEMIC_SPELLINGS

Spellings = dict[str, list[str]]


def _forms(header: str) -> tuple[str, str]:
    lowered = header.lower()
    return lowered.strip(), re.sub(r"[^a-z0-9]", "", lowered)


def match_columns(columns: list[str], spellings: Spellings = ACADEMIC_SPELLINGS) -> dict[str, str]:
    """Canonical field -> source column.

    A header matches a spelling when both are equal ignoring case and outer
    blanks, or ignoring everything but letters and digits. Earlier spellings,
    then earlier columns, win. Only names are looked at, never rows.
    """
    forms = [(column, *_forms(column)) for column in columns]
    mapping: dict[str, str] = {}
    for fld, accepted in spellings.items():
        hits = (
            column
            for plain, bare in map(_forms, accepted)
            for column, column_plain, column_bare in forms
            if column_plain == plain or column_bare == bare
        )
        chosen = next(hits, None)
        if chosen is not None:
            mapping[fld] = chosen
    return mapping


def unmatched_fields(columns: list[str], spellings: Spellings = ACADEMIC_SPELLINGS) -> list[str]:
    mapping = match_columns(columns, spellings)
    return [fld for fld in spellings if fld not in mapping]


def check_mapping(columns: list[str], mapping: dict[str, str] | None) -> dict[str, str]:
    """The non-blank part of ``mapping``; raises if it is empty or names unknown columns."""
    used = {fld: column for fld, column in (mapping or {}).items() if column and str(column).strip()}
    if not used:
        raise ValueError("column mapping is empty: map at least one source column")
    unknown = [f"{column!r} (for {fld!r})" for fld, column in used.items() if column not in columns]
    if unknown:
        raise ValueError("column mapping names columns the source lacks: " + ", ".join(unknown))
    return used


def rename_mapped(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename source columns to their canonical fields; other columns stay."""
    used = check_mapping(df.columns, mapping)
    return df.withColumnsRenamed({column: fld for fld, column in used.items()})


def harmonise(
    sources: dict[str, DataFrame],
    spellings: Spellings = ACADEMIC_SPELLINGS,
    *,
    source_column: str | None = None,
) -> DataFrame:
    """Stack sources with different headers under the canonical names.

    Columns a source lacks are null. A field that is text in one source and of
    another type in a second becomes text in all. ``source_column`` names an
    optional extra column holding the source's key.
    """
    named = {name: rename_mapped(df, match_columns(df.columns, spellings)) for name, df in sources.items()}
    kinds: dict[str, set[str]] = {}
    for df in named.values():
        for column, kind in df.dtypes:
            kinds.setdefault(column, set()).add(kind)
    frames = []
    for name, renamed in named.items():
        clashing = [c for c in renamed.columns if len(kinds[c]) > 1 and "string" in kinds[c]]
        renamed = renamed.withColumns({c: F.col(f"`{c}`").cast("string") for c in clashing})
        frames.append(renamed.withColumn(source_column, F.lit(name)) if source_column else renamed)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def mapping_coverage(sources: dict[str, DataFrame], spellings: Spellings = ACADEMIC_SPELLINGS) -> DataFrame:
    """One row per (source, field): mapped or not, from which column, how many values.

    Each source is read once, whatever the number of fields.
    """
    reports = []
    for name, df in sources.items():
        mapping = match_columns(df.columns, spellings)
        counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(fld) for fld, c in mapping.items()], F.count(F.lit(1)).alias("_rows"))
        entries = [
            F.struct(
                F.lit(name).alias("source"),
                F.lit(fld).alias("field"),
                F.lit(fld in mapping).alias("mapped"),
                F.lit(mapping.get(fld)).cast("string").alias("source_column"),
                (F.col(fld) if fld in mapping else F.lit(0)).cast("bigint").alias("values_present"),
            )
            for fld in spellings
        ]
        reports.append(counts.select(F.inline(F.array(*entries))))
    return reduce(DataFrame.unionByName, reports)
