"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scorewright.llm import (
    bagminhash, bwt_merge, grammar_store, line_windows, merge_dropout, minhash, nearest_toxic, packing, rule_ensemble, secret_scan,
    shallot, turn_repair, weak_rules,
)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.score_quality(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op2_repair_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar_store.encode_corpus(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 49_408, 1)


def op3_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_toxic.score_toxicity(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.copy_classes(_docs(spark, sf_dir)).select("doc_id", "class_id")


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_windows.dedup_lines(_docs(spark, sf_dir))
    return done.select("row_.doc_id", "row_.text", "dedup_.n_lines", "dedup_.n_removed")


def op6_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_docs(spark, sf_dir))


def op7_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_neighbours(_docs(spark, sf_dir))


def op9_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.round_trips(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(_docs(spark, sf_dir))


def op11_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_merge.removals(_docs(spark, sf_dir))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turn_repair.audits(turn_repair.damaged(rows), rows)


def op13_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.assignments(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_rule_ensemble, op2_repair_store, op3_nearest_toxic, op4_bagminhash, op5_line_windows, op6_markov_secrets, op7_residual_packing,
    op8_minhash, op9_merge_dropout, op10_weak_rules, op11_bwt_merge, op12_turn_repair, op13_shallot)}
ORACLES: dict[str, str] = {"op5_line_windows": line_windows.ORACLE, "op13_shallot": shallot.ORACLE}
