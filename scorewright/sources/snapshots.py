"""Stored tables that are switched as a whole: version folders, and a manifest that names those in use.

A write makes a new folder of its own; only when it has ended is the manifest replaced, by one rename. A failed or
killed write leaves the old table readable, readers that have begun keep their files, and a table may be rewritten from
itself. A bucketed table has its rows by a hash of their key in folders of their own, so an upsert reads and writes the
buckets that its batch touches and leaves all others as they are.

Folders that no manifest names any more stay until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorewright.functions.names import ref
from scorewright.operators.ordering import last_per_key
from scorewright.session import materialise

MANIFEST = "_manifest.json"
_BUCKET = "_bucket"


def _files(spark: SparkSession, path: str):
    """The file system of ``path``, and its path class."""
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return paths(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), paths


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The table's manifest: schema, keys, number of buckets, folders by bucket ("" if not bucketed)."""
    files, paths = _files(spark, path)
    at = paths(f"{path}/{MANIFEST}")
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        size = files.getFileStatus(at).getLen()
        return json.loads(bytes(stream.readNBytes(int(size))).decode())
    finally:
        stream.close()


def _switch(spark: SparkSession, path: str, content: dict) -> None:
    files, paths = _files(spark, path)
    fresh = paths(f"{path}/_{uuid.uuid4().hex}.json")
    stream = files.create(fresh, True)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, paths(f"{path}/{MANIFEST}"), options)


def _read(spark: SparkSession, path: str, content: dict, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], content["schema"])
    return spark.read.schema(content["schema"]).parquet(*[f"{path}/{f}" for f in folders])


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as its manifest stands now; None if there is none."""
    content = manifest(spark, path)
    return None if content is None else _read(spark, path, content, list(content["folders"].values()))


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[ref(k) for k in keys]), F.lit(buckets)).cast("int")


def _schema(df: DataFrame) -> str:
    """As DDL text; stored columns may be null."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def _written(df: DataFrame, path: str, keys: list[str], buckets: int) -> dict[str, str]:
    """Write a version; its folders by bucket."""
    spark, version = df.sparkSession, f"_v-{uuid.uuid4().hex}"
    if not buckets:
        df.write.parquet(f"{path}/{version}")
        return {"": version}
    (df.withColumn(_BUCKET, _bucket(keys, buckets)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/{version}"))
    files, paths = _files(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(paths(f"{path}/{version}")) if s.isDirectory()]
    return {n.split("=")[1]: f"{version}/{n}" for n in names if n.startswith(f"{_BUCKET}=")}


def replace_snapshot(df: DataFrame, path: str, keys: list[str] = (), buckets: int = 0) -> DataFrame:
    """Store ``df`` as the whole table; with ``buckets``, by a hash of ``keys``."""
    content = {"schema": _schema(df), "keys": list(keys), "buckets": buckets, "folders": _written(df, path, list(keys), buckets)}
    _switch(df.sparkSession, path, content)
    return read_snapshot(df.sparkSession, path)


def upsert_snapshot(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[str], buckets: int = 64) -> DataFrame:
    """Insert or overwrite every key of ``new`` (its last row per key in ``order``) and return the stored table.

    A first load makes the table with ``buckets``; later ones keep its number. Only buckets that hold a key of ``new`` are
    read and written.
    """
    content = manifest(spark, path)
    batch = materialise(last_per_key(new, keys, order), "upsert")
    if content is None:
        return replace_snapshot(batch, path, keys, buckets)
    if content["keys"] != list(keys) or not content["buckets"]:
        raise ValueError(f"the table is bucketed by {content['keys']}, not by {list(keys)}")
    where = _bucket(keys, content["buckets"])
    touched = sorted(str(r[0]) for r in batch.select(where).distinct().collect())  # as many as buckets at most
    if not touched:
        return read_snapshot(spark, path)
    old = _read(spark, path, content, [content["folders"][b] for b in touched if b in content["folders"]])
    same = None
    slim = batch.select(*[ref(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    for i, k in enumerate(keys):
        equal = ref(k).eqNullSafe(F.col(f"_k{i}"))
        same = equal if same is None else same & equal
    merged = old.join(slim, same, "left_anti").unionByName(batch.select(*[ref(c) for c in old.columns]))
    fresh = _written(merged, path, list(keys), content["buckets"])
    _switch(spark, path, content | {"folders": {b: f for b, f in content["folders"].items() if b not in touched} | fresh})
    return read_snapshot(spark, path)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the version folders that the manifest does not name; returns how many. No reader of them may be left."""
    content, (files, paths) = manifest(spark, path), _files(spark, path)
    if content is None:
        return 0
    used = set(content["folders"].values()) | {f.split("/")[0] for f in content["folders"].values() if "/" not in f}
    gone = 0
    for version in files.listStatus(paths(path)):
        name = version.getPath().getName()
        if not name.startswith("_v-") or name in used:
            continue
        below = [f"{name}/{s.getPath().getName()}" for s in files.listStatus(version.getPath()) if s.isDirectory()]
        unused = [f for f in below if f not in used]
        if len(unused) == len(below):
            gone += bool(files.delete(version.getPath(), True))
        else:
            gone += sum(bool(files.delete(paths(f"{path}/{f}"), True)) for f in unused)
    return gone
