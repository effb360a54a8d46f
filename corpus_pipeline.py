"""From raw documents to packed training sequences: five stages, each written as Parquet and read again as the next one's input.

1. quality classifier: documents that the rule ensemble rejects go;
2. line dedup: repeated three-line passages are cut from the texts;
3. near dedup: one document of each class of near copies stays;
4. secret scans: secrets are masked in the texts;
5. best-fit packing: the rest is encoded and packed into sequences; a row per piece.

The first four return the columns of documents; ``n_chars``, where there is one, follows the text.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from scorewright.llm import bagminhash, line_windows, packing, rule_ensemble, secret_scan
from scorewright.session import settled


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` set to the text's length, null for a null text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rule_ensemble.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_windows.flat(line_windows.dedup_lines(docs)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secret_scan.masked(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("secrets", secrets), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = settled(spark, partial(stage, spark, rows, sf_dir), name)  # what the stage staged on its way is deleted
    return rows


ORACLE_SQL = None  # models, signatures and packing have no SQL form; tests compare with plain versions
