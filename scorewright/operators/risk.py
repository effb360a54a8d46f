"""Risk labels, split, classifiers, scores and levels."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorewright.functions.numbers import round_even
from scorewright.operators.forest import Forest, grow_forest
from scorewright.operators.ordering import running_counts
from scorewright.presets import RISK_BOUNDS, RISK_LEVELS, RISK_LEVEL_DEFAULT
from scorewright.session import materialise, new_path

LABEL, PROBABILITY = "is_at_risk", "probability"

# Model names and their settings.
LOGISTIC, FOREST, BOOSTED = "Logistic Regression", "Random Forest", "XGBoost"
LOGISTIC_ITERATIONS = 1000
FOREST_TREES = 100
BOOSTED_ROUNDS, BOOSTED_DEPTH, BOOSTED_RATE = 50, 3, 0.1
TEST_SHARE, SEED = 0.3, 42

# Trees grow until pure in the original; a distributed tree needs a depth bound.
FOREST_DEPTH = 30

# Rows of a training task; smaller tables are dealt over the tasks of LEAST_TASKS, of LEAST_ROWS at least.
TASK_ROWS, LEAST_TASKS, LEAST_ROWS = 100_000, 16, 500

# A forest of more rows is grown by ``grow_forest``: Spark's own passes over all rows for each of its 31 levels.
FOREST_PASS_ROWS = 200_000


def risk_label(df: DataFrame, bounds: dict[str, float] = RISK_BOUNDS, alias: str = LABEL) -> DataFrame:
    """1 where any bounded column is below its bound (null is not below), else 0."""
    used = [F.coalesce(F.col(c) < b, F.lit(False)) for c, b in bounds.items() if c in df.columns]
    if not used:
        raise ValueError(f"risk label needs at least one of {sorted(bounds)}")
    return df.withColumn(alias, reduce(lambda a, b: a | b, used).cast("int"))


def stratified_split(
    df: DataFrame, entity: str, label: str = LABEL, *, test_share: float = TEST_SHARE, seed: int = SEED,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Adds ``is_test``: exactly round(share * n) rows per label, the same on every run.

    Rows are ordered by a hash of seed and entity. A label holds a large part
    of all rows, so its order is found bucket by bucket, not in one window.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(entity).cast("string")))
    table = materialise(df.withColumn("_digest", digest), "split")
    place = F.conv(F.substring("_digest", 1, 12), 16, 10).cast("double")
    keyed = table.withColumns({"_place": place, "_one": F.lit(1)})
    options = {"rows_per_bucket": rows_per_bucket} if rows_per_bucket else {}
    placed = running_counts(keyed, "_place", ["_one"], [label], tie_order=["_digest", entity], **options)
    wanted = F.round(F.col("_one_total") * F.lit(float(test_share)))
    return placed.select(*df.columns, (F.col("_one_before") < wanted).alias("is_test"))


def _assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def _stored(model):
    """The model saved in the work folder and read back, without its training summary.

    The summary holds on to the session, and with it everything that cannot be
    sent to the executors when the model is applied.
    """
    path = new_path(SparkSession.active(), "model")
    model.write().save(path)
    return type(model).load(path)


def _dealt(train: DataFrame, features: list[str], label: str, entity: str | None) -> tuple[DataFrame, int]:
    """Rows dealt evenly over tasks, and their number.

    Training passes over the rows many times and its cost is by the row, while files are cut by bytes, so that a few
    tasks would hold all rows. Tasks and their order are those of a hash of ``entity`` (or of the whole row): bootstrap
    weights, which are drawn by place, do not depend on the files, and are the same when a lost task runs again.
    """
    number = train.count()
    tasks = max(1, min(LEAST_TASKS, number // LEAST_ROWS), number // TASK_ROWS)
    dealt = (
        train.withColumn("_deal", F.xxhash64(entity or "*")).repartition(tasks, "_deal")
        .sortWithinPartitions("_deal", *features, label)
    )
    return dealt, number


def _vectors(dealt: DataFrame, features: list[str], label: str) -> DataFrame:
    return _assemble(dealt, features).select("features", F.col(label).cast("double").alias(label))


def train_logistic(train: DataFrame, features: list[str], label: str = LABEL, *, entity: str | None = None):
    """L2-regularised logistic regression, unit penalty on the summed loss."""
    rows, number = _dealt(train, features, label, entity)
    estimator = LogisticRegression(
        featuresCol="features", labelCol=label, maxIter=LOGISTIC_ITERATIONS, regParam=1.0 / max(number, 1),
        elasticNetParam=0.0, standardization=False, tol=1e-6,
    )
    return _stored(estimator.fit(_vectors(rows, features, label)))


def train_forest(
    train: DataFrame, features: list[str], label: str = LABEL, *, depth: int = FOREST_DEPTH, entity: str | None = None
):
    """Rows keep the node that each tree has led them to, so that a level costs one step a row and not the way from the
    root, and tasks are not sent the trees. The copy has no training summary (see ``_stored``); to save and load as many
    nodes as a deep forest has would take the driver longer than to apply it. Beyond ``FOREST_PASS_ROWS`` rows the forest
    is grown, and applied, without a pass over all rows for each level and without all nodes in one place."""
    rows, number = _dealt(train, features, label, entity)
    if number > FOREST_PASS_ROWS:
        return grow_forest(rows, number, features, label, trees=FOREST_TREES, depth=depth, seed=SEED)
    estimator = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=FOREST_TREES, maxDepth=depth, seed=SEED,
        featureSubsetStrategy="sqrt", maxMemoryInMB=1024, cacheNodeIds=True,
    )
    return estimator.fit(_vectors(rows, features, label)).copy()


def train_boosted(train: DataFrame, features: list[str], label: str = LABEL, *, entity: str | None = None):
    rows, _ = _dealt(train, features, label, entity)
    return GBTClassifier(
        featuresCol="features", labelCol=label, maxIter=BOOSTED_ROUNDS, maxDepth=BOOSTED_DEPTH,
        stepSize=BOOSTED_RATE, seed=SEED, maxMemoryInMB=1024,
    ).fit(_vectors(rows, features, label))


TRAINERS = {LOGISTIC: train_logistic, FOREST: train_forest, BOOSTED: train_boosted}


def train_all(train: DataFrame, features: list[str], label: str = LABEL, *, entity: str | None = None) -> Iterator[tuple]:
    """Name and model of every trainer, each as it is done: they train side by side on the same rows.

    A training is a long chain of short jobs; what one leaves idle between its jobs and in their last tasks, another
    uses. The caller may stage tables while others still train.
    """
    as_here = inheritable_thread_target(train.sparkSession)
    with ThreadPoolExecutor(len(TRAINERS)) as pool:
        names = {
            pool.submit(as_here(trainer), train, features, label, entity=entity): name
            for name, trainer in TRAINERS.items()
        }
        for done in as_completed(names):
            yield names[done], done.result()


def predict(model, df: DataFrame, features: list[str], alias: str = PROBABILITY) -> DataFrame:
    """``df`` with the probability of label 1."""
    keep = [c for c in df.columns if c != alias]
    if isinstance(model, Forest):
        return model.predict(df.select(*keep), features, alias)
    scored = model.transform(_assemble(df.select(*keep), features))
    return scored.select(*keep, vector_to_array("probability")[1].alias(alias))


def check_both_classes(df: DataFrame, label: str = LABEL) -> None:
    ends = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    if ends["lo"] == ends["hi"]:
        raise ValueError("training needs both at-risk and not-at-risk examples")


def score_all(
    df: DataFrame, features: list[str], model_name: str = FOREST, label: str = LABEL, *, entity: str | None = None
) -> DataFrame:
    """Fit on all rows and score the same rows (optimistic by design; unknown names mean the forest)."""
    table = materialise(df, "to-score")
    check_both_classes(table, label)
    return predict(TRAINERS.get(model_name, train_forest)(table, features, label, entity=entity), table, features)


def feature_importance(model, features: list[str], *, digits: int | None = 3) -> DataFrame:
    """Coefficients or importances per feature, largest magnitude first."""
    spark = SparkSession.active()
    values = model.coefficients if hasattr(model, "coefficients") else model.featureImportances
    rows = [(name, float(v)) for name, v in zip(features, values.toArray())]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.withColumn("importance", round_even(F.col("importance"), digits)).orderBy(
        F.desc(F.abs("importance")), "feature"
    )


def threshold_predictions(
    df: DataFrame, threshold_percent: float = 50.0, probability: str = PROBABILITY, alias: str = "prediction"
) -> DataFrame:
    return df.withColumn(alias, F.when(F.col(probability) >= threshold_percent / 100.0, 1).otherwise(0))


def level_of(probability: Column) -> Column:
    label = None
    for bound, name in RISK_LEVELS:
        label = F.when(probability >= bound, name) if label is None else label.when(probability >= bound, name)
    return label.otherwise(RISK_LEVEL_DEFAULT)


def risk_bands(
    df: DataFrame, entity: str, probability: str = PROBABILITY, *, digits: int | None = 2
) -> DataFrame:
    """Entity, probability as a percentage, and level (by the unrounded value)."""
    return df.select(
        entity,
        round_even(F.col(probability) * 100.0, digits).alias("risk_probability"),
        level_of(F.col(probability)).alias("risk_level"),
    )
