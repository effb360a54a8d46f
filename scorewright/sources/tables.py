"""Tables at rest: scan, replace, keyed upsert, refresh, status updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from scorewright.operators.ordering import last_per_key
from scorewright.presets import ACTION_STATUSES
from scorewright.session import materialise
from scorewright.sources.snapshots import read_snapshot, replace_snapshot


def table_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` is a folder or ``path`` names a catalog table."""
    if "/" not in path:
        return spark.catalog.tableExists(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def scan_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame | None:
    """A stored table (snapshot or parquet folder, or catalog name); None if there is none."""
    if not table_exists(spark, path):
        return None
    df = None if "/" in path else spark.table(path)
    if df is None:
        df = read_snapshot(spark, path)
    if df is None:
        df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def replace_table(df: DataFrame, path: str, *, partition_by: list[str] = ()) -> DataFrame:
    """Make ``df`` the whole table at ``path`` and return the stored table.

    The table is a snapshot: a failing write leaves the old one readable, and
    ``df`` may read from ``path``. With ``partition_by`` it is a plain folder,
    overwritten, and ``df`` must not read from it.
    """
    if not partition_by:
        return replace_snapshot(df, path)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def refresh_table(df: DataFrame, path: str) -> DataFrame:
    """Rebuild a result table in full: no earlier row survives."""
    return replace_table(df, path)


def upsert_latest(old: DataFrame | None, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``old`` with every key of ``new`` inserted or overwritten.

    Within ``new`` the last row per key in ``order`` wins. The surviving batch
    is written once, so the planner knows its size: a small batch is broadcast
    and the large old table is streamed without a shuffle; a large batch is
    merged by shuffled join. ``old`` holds each key at most once.
    """
    batch = materialise(last_per_key(new, keys, order), "upsert")
    if old is None:
        return batch
    kept = old.join(batch.select(*keys), keys, "left_anti")
    return kept.unionByName(batch.select(*old.columns))


def upsert_table(
    spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[str], out_path: str
) -> DataFrame:
    """Upsert ``new`` into the table at ``path``, stored as ``out_path``."""
    return replace_table(upsert_latest(scan_table(spark, path), new, keys, order), out_path)


def load_counts(tables: dict[str, DataFrame], folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Store each table under ``folder`` and report the rows written.

    Counts come from the stored files' footers. (Observing the writes would
    leave the session unable to apply models that keep a training summary.)
    """
    stored = {name: replace_table(df, f"{folder}/{name}") for name, df in tables.items()}
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows_loaded")).select(F.lit(name).alias("table_name"), "rows_loaded")
        for name, df in stored.items()
    ]
    return stored, reduce(DataFrame.unionByName, counts)


def apply_status_updates(
    actions: DataFrame,
    updates: DataFrame,
    *,
    key: str = "id",
    status: str = "status",
    order: str = "seq",
    allowed: tuple[str, ...] = ACTION_STATUSES,
) -> DataFrame:
    """Set the status of the given actions; the last update per key wins.

    Updates to a status outside ``allowed`` are ignored, as are unknown keys.
    """
    valid = updates.where(F.col(status).isin(*allowed)).select(key, F.col(status).alias("_status"), order)
    latest = last_per_key(valid, [key], [order]).select(key, "_status")
    return (
        actions.join(latest, key, "left")
        .withColumn(status, F.coalesce("_status", status))
        .select(*actions.columns)
    )


def toggle_status(status_column: str = "status"):
    """The other one of PENDING and RESOLVED."""
    return F.when(F.col(status_column) == "PENDING", "RESOLVED").otherwise("PENDING")
