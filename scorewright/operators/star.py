"""Flat records to a small star schema, and its constraints as reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions.text import derive_key
from scorewright.operators.ordering import first_per_key, last_per_key
from scorewright.session import materialise

# Columns that must all be present before the split.
STAR_REQUIRED = ["student_id", "student_name", "department", "semester", "academic_year", "subject"]
# Measures per fact table with their value when the column is absent.
ATTENDANCE_DEFAULTS = {"attendance": 100.0}
ASSESSMENT_DEFAULTS = {"internal_1": 0.0, "internal_2": 0.0, "assignment_score": 0.0, "quiz_score": 0.0,
                       "final_exam": 0.0, "assignment_completion": 0.0}
PERFORMANCE_DEFAULTS = {"performance_index": 0.0, "current_gpa": 0.0, "performance_change": 0.0,
                        "performance_trend": "STABLE"}
BEHAVIOR_DEFAULTS = {"study_hours": 0.0, "lms_activity": 0}


def can_split(columns: list[str]) -> bool:
    return all(c in columns for c in STAR_REQUIRED)


def distinct_dims(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct combinations of a few columns."""
    return df.select(*columns).distinct()


def _or_default(df: DataFrame, defaults: dict) -> list[Column]:
    return [F.col(c) if c in df.columns else F.lit(v).alias(c) for c, v in defaults.items()]


def split_star(records: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """Six tables from flat records: dimensions, and facts keyed by (student, subject).

    ``order`` gives the input order: the first row describes a student, the
    last row of a (student, subject) pair is its fact, and where one subject
    key occurs with several (name, department) pairs, the pair seen last wins.
    """
    missing = [c for c in STAR_REQUIRED if c not in records.columns]
    if missing:
        raise ValueError(f"star split needs columns {missing}")
    keyed = records.withColumn("subject_id", derive_key(F.col("subject")))

    pairs = keyed.groupBy("subject_id", F.col("subject").alias("subject_name"), "department").agg(
        F.min(F.struct(*order)).alias("_seen")
    )
    subjects = last_per_key(pairs, ["subject_id"], ["_seen"]).drop("_seen")

    previous = "previous_gpa" if "previous_gpa" in records.columns else None
    profile = keyed.select(
        "student_id",
        "student_name",
        "department",
        F.col("semester").try_cast("int").alias("semester"),
        "academic_year",
        (F.col(previous) if previous else F.lit(None)).cast("double").alias("previous_gpa"),
        *_or_default(records, BEHAVIOR_DEFAULTS),
        F.struct(*order).alias("_seen"),
    )
    first_rows = first_per_key(profile, ["student_id"], ["_seen"])

    facts = keyed.select(
        "student_id",
        "subject_id",
        *_or_default(records, ATTENDANCE_DEFAULTS),
        *_or_default(records, ASSESSMENT_DEFAULTS),
        *_or_default(records, PERFORMANCE_DEFAULTS),
        F.struct(*order).alias("_seen"),
    )
    latest = last_per_key(facts, ["student_id", "subject_id"], ["_seen"])
    key = ["student_id", "subject_id"]
    return {
        "students": first_rows.select(
            "student_id", "student_name", "department", "semester", "academic_year", "previous_gpa"
        ),
        "subjects": subjects.select("subject_id", "subject_name", "department"),
        "learning_behavior": first_rows.select(
            "student_id", F.col("study_hours").cast("double"), F.col("lms_activity").cast("int")
        ),
        "attendance": latest.select(*key, F.col("attendance").alias("attendance_pct")),
        "assessments": latest.select(*key, *ASSESSMENT_DEFAULTS),
        "student_performance": latest.select(*key, *PERFORMANCE_DEFAULTS),
    }


@dataclass(frozen=True)
class TableRules:
    """Constraints of one table."""

    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    ranges: tuple[tuple[str, float, float], ...] = ()
    parents: tuple[tuple[str, str, str], ...] = ()  # (column, parent table, parent column)


_FACT_PARENTS = (("student_id", "students", "student_id"), ("subject_id", "subjects", "subject_id"))

# Keys, required columns, value ranges and parents of each table.
STAR_RULES = {
    "students": TableRules(("student_id",), ("student_name", "department", "semester", "academic_year"),
                           (("previous_gpa", 0.0, 10.0),)),
    "subjects": TableRules(("subject_id",), ("subject_name", "department")),
    "learning_behavior": TableRules(("student_id",), parents=(("student_id", "students", "student_id"),)),
    "attendance": TableRules(("student_id", "subject_id"), (), (("attendance_pct", 0.0, 100.0),), _FACT_PARENTS),
    "assessments": TableRules(("student_id", "subject_id"), parents=_FACT_PARENTS),
    "student_performance": TableRules(("student_id", "subject_id"), parents=_FACT_PARENTS),
    "risk_predictions": TableRules(("student_id",), parents=(("student_id", "students", "student_id"),)),
    "interventions": TableRules(("id",), parents=(("student_id", "students", "student_id"),)),
}


def _row_checks(rules: TableRules) -> list[tuple[str, str, Column]]:
    """(rule, column, violated) of the checks that a row decides alone."""
    checks = [("not_null", c, F.col(c).isNull()) for c in (*rules.key, *rules.required)]
    return checks + [("range", c, F.coalesce(~F.col(c).between(lo, hi), F.lit(False))) for c, lo, hi in rules.ranges]


def _set_number(columns: list[str], members: tuple[str, ...]) -> int:
    """``grouping_id`` of the grouping set of ``members``: a bit for each column it leaves out."""
    return sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in members)


def _counted(df: DataFrame, rules: TableRules, parents: list[str]) -> tuple[DataFrame, list[str]]:
    """One scan of a table: rows and violations in all, and rows by key and by each parent's column (grouping sets)."""
    columns = list(dict.fromkeys([*rules.key, *parents]))
    sets = list(dict.fromkeys([rules.key, *[(c,) for c in parents], ()]))
    flags = [F.count_if(bad).alias(f"_c{i}") for i, (_, _, bad) in enumerate(_row_checks(rules))]
    counted = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.count(F.lit(1)).alias("_n"), F.grouping_id(*columns).alias("_set"), *flags)
    return materialise(counted, "constraint-counts"), columns


def check_constraints(tables: dict[str, DataFrame], rules: dict[str, TableRules] = STAR_RULES) -> DataFrame:
    """One row per (table, constraint) with its number of violating rows.

    Each table is scanned once: row checks and the counts by key and by each parent's column come from one aggregate.
    Parent lookups join counts with counts, so a frequent orphan key moves as one row.
    """
    counts = {name: _counted(df, rules[name], [c for c, parent, _ in rules[name].parents if parent in tables])
              for name, df in tables.items()}

    def of(name: str, members: tuple[str, ...]) -> DataFrame:
        counted, columns = counts[name]
        return counted.where(F.col("_set") == _set_number(columns, members))

    def line(name: str, rule: str, columns: str, rows: DataFrame, violations: Column) -> DataFrame:
        return rows.agg(F.coalesce(F.sum(violations), F.lit(0)).alias("violations")).select(
            F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), F.lit(columns).alias("columns"), "violations")

    reports = []
    for name in tables:
        r = rules[name]
        for i, (kind, column, _) in enumerate(_row_checks(r)):
            reports.append(line(name, kind, column, of(name, ()), F.col(f"_c{i}")))
        reports.append(line(name, "unique", ",".join(r.key), of(name, r.key), F.col("_n") - 1))
        for column, parent, parent_column in r.parents:
            if parent not in tables:
                continue
            if rules[parent].key == (parent_column,):
                known = of(parent, rules[parent].key).select(F.col(parent_column).alias(column))
            else:
                known = tables[parent].select(F.col(parent_column).alias(column)).distinct()
            orphans = of(name, (column,)).where(F.col(column).isNotNull()).select(column, "_n").join(known, column, "left_anti")
            reports.append(line(name, "foreign_key", f"{column}->{parent}", orphans, F.col("_n")))
    return reduce(DataFrame.unionByName, reports)


def judged(
    df: DataFrame, rules: TableRules, parents: dict[str, DataFrame] | None = None, *, unique: bool = True,
    alias: str = "reasons",
) -> DataFrame:
    """``df`` with the constraints each row violates, as an array of ``rule:columns`` in order of the checks.

    With ``unique`` all rows of a key that several rows have are violations: which of them is right is not decided
    here. Rows meet counts of repeated keys, and parent keys once each, so the table is scanned twice at most.
    """
    found = [F.when(bad, F.lit(f"{kind}:{column}")) for kind, column, bad in _row_checks(rules)]
    rows = df
    if unique:
        again = df.groupBy(*rules.key).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
        named = again.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(rules.key)], "_copies")
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_key{i}") for i, c in enumerate(rules.key)])
        rows = rows.join(named, same, "left")
        found.append(F.when(F.col("_copies").isNotNull(), F.lit(f"unique:{','.join(rules.key)}")))
    for i, (column, parent, parent_column) in enumerate(rules.parents):
        if parents and parent in parents:
            known = parents[parent].select(F.col(parent_column).alias(f"_of{i}")).distinct().withColumn(f"_is{i}", F.lit(True))
            rows = rows.join(known, F.col(column) == F.col(f"_of{i}"), "left")
            found.append(F.when(F.col(f"_is{i}").isNull() & F.col(column).isNotNull(), F.lit(f"foreign_key:{column}->{parent}")))
    return rows.select(*[df[c] for c in df.columns], F.array_compact(F.array(*found)).alias(alias))


def split_valid(
    df: DataFrame, rules: TableRules, parents: dict[str, DataFrame] | None = None, *, unique: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) rows by row checks, repeated keys (if ``unique``) and parent keys; ``judged`` says why."""
    rows = judged(df, rules, parents, unique=unique, alias="_reasons")
    return (
        rows.where(F.size("_reasons") == 0).select(*df.columns),
        rows.where(F.size("_reasons") > 0).select(*df.columns),
    )


def key_collisions(records: DataFrame, column: str = "subject", width: int = 10) -> DataFrame:
    """Derived keys shared by several distinct names, with the number of names."""
    names = records.select(column).where(F.col(column).isNotNull()).distinct()
    return (
        names.groupBy(derive_key(F.col(column), width).alias("derived_key"))
        .agg(F.count(F.lit(1)).alias("names"))
        .where(F.col("names") > 1)
    )
