"""Run a registered query in Spark and its SQL in DuckDB, and compare all rows.

    python -m tests.oracle [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time
from collections import Counter

import duckdb

from scorewright import workload

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


_KINDS = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, con, name: str, sf_dir: str) -> list[str]:
    """Differences between both results; empty when they agree."""
    df = workload.QUERIES[name](spark, sf_dir)
    order = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    if name not in workload.ORACLES:
        return [] if got else ["no rows"]
    rel = con.sql(workload.ORACLES[name])
    problems = []
    if sorted(rel.columns) != order:
        return [f"columns {order} vs {sorted(rel.columns)}"]
    types = dict(zip(rel.columns, map(str, rel.types)))
    for c, kind in df.dtypes:
        if _KINDS.get(kind, kind) != types[c]:
            problems.append(f"type of {c}: {kind} vs {types[c]}")
    at = {c: i for i, c in enumerate(rel.columns)}
    want = Counter(tuple(_plain(r[at[c]]) for c in order) for r in rel.fetchall())
    if got != want:
        problems.append(f"rows {sum(got.values())} vs {sum(want.values())}; columns {order}")
        problems += [f"  spark only: {r}" for r in sorted((got - want))[:3]]
        problems += [f"  sql only:   {r}" for r in sorted((want - got))[:3]]
    if not want:
        problems.append("sql gives no rows")
    return problems


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = session(), connect(args.sf)
    bad = 0
    for name in args.names or workload.QUERIES:
        start = time.time()
        try:
            problems = compare(spark, con, name, args.sf)
        except Exception as e:  # report and go on with the next query
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        kind = "sql" if name in workload.ORACLES else "rows"
        print(f"{'ok ' if not problems else 'BAD'} {kind:4} {time.time() - start:6.2f}s {name}", flush=True)
        for p in problems:
            print("    " + p, flush=True)
        bad += bool(problems)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
