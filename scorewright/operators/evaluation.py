"""Classifier evaluation as plain aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions.numbers import round_even
from scorewright.operators.ordering import ROWS_PER_BUCKET, running_counts
from scorewright.session import materialise


def _cell(label: str, prediction: str, actual: int, predicted: int) -> Column:
    return F.count_if((F.col(label) == actual) & (F.col(prediction) == predicted)).cast("double")


def classification_metrics(df: DataFrame, label: str, prediction: str, *, digits: int | None = 3) -> DataFrame:
    """Accuracy, precision, recall and F1 in one row; undefined ratios are 0."""
    tp, fp = _cell(label, prediction, 1, 1), _cell(label, prediction, 0, 1)
    fn, tn = _cell(label, prediction, 1, 0), _cell(label, prediction, 0, 0)

    def ratio(part: Column, whole: Column) -> Column:
        return round_even(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), digits)

    return df.agg(
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2.0 * tp, 2.0 * tp + fp + fn).alias("f1_score"),
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Four rows (actual, predicted, count), absent cells as 0."""
    cells = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), _cell(label, prediction, a, p).cast("bigint").alias("count"))
        for a in (0, 1)
        for p in (0, 1)
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Stored (score, positives, negatives) per distinct score."""
    return materialise(
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg")),
        "scores",
    )


def roc_curve(
    df: DataFrame, label: str, score: str, *, digits: int | None = 3, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """(threshold, fpr, tpr) at each distinct score, and the origin at threshold infinity.

    Every point is kept, also those on a straight line.
    """
    ranked = running_counts(
        score_counts(df, label, score), "score", ["pos", "neg"], descending=True, rows_per_bucket=rows_per_bucket
    )

    def rate(kind: str) -> Column:
        done = (F.col(f"{kind}_before") + F.col(kind)).cast("double")
        return round_even(F.try_divide(done, F.col(f"{kind}_total").cast("double")), digits)

    points = ranked.select(F.col("score").alias("threshold"), rate("neg").alias("fpr"), rate("pos").alias("tpr"))
    origin = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], points.schema)
    return origin.unionByName(points)


def roc_auc(
    df: DataFrame, label: str, score: str, *, digits: int | None = 3, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Area under the curve: share of (positive, negative) pairs in the right order, ties half."""
    ranked = running_counts(score_counts(df, label, score), "score", ["neg"], rows_per_bucket=rows_per_bucket)
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(round_even(F.try_divide(won, pairs), digits).alias("roc_auc"))
