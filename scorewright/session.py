"""Where intermediate tables live.

Multi-pass operators write their shared input once as a parquet table and read
it back. This cuts the lineage, survives executor loss, and gives the planner
true sizes, so it only broadcasts a side that is really small.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_staged: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary folder is made only for a local session that names none.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="scorewright-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the work folder that no earlier write has used."""
    path = f"{work_dir(spark)}/scorewright/{label}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files of what runs inside are deleted as each job's query ends, not when the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the work folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], label: str = "stage") -> DataFrame:
    """The table that ``build`` makes, written; intermediate tables that it staged on the way are deleted."""
    mark = len(_staged)
    out = materialise(build(), label)
    made = _staged[mark:]
    del _staged[mark:]
    _staged.append(made.pop())
    _delete(spark, made)
    return out


class Grown:
    """A table in the work folder that is appended to; plans that read it stay as small as a scan."""

    def __init__(self, spark: SparkSession, schema: str, label: str):
        self.spark, self.schema, self.path, self.filled = spark, schema, new_path(spark, label), False

    def add(self, rows: DataFrame) -> None:
        with _shuffles_dropped(self.spark):
            rows.write.mode("append").parquet(self.path)
        self.filled = True

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def release_stages(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process; returns how many.

    Call it when no DataFrame built on them is needed any more.
    """
    paths = _staged[:]
    _staged.clear()
    return _delete(spark, paths)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    released = 0
    for path in reversed(paths):
        target = jvm.org.apache.hadoop.fs.Path(path)
        released += bool(target.getFileSystem(conf).delete(target, True))
    return released
