"""K-means segmentation: choosing k, naming and profiling segments."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from scorewright.functions.numbers import round_even
from scorewright.operators.features import minmax_scale
from scorewright.presets import SEGMENT_BEST, SEGMENT_MIDDLE, SEGMENT_WORST
from scorewright.session import materialise

# Range of k tried, its fallback, restarts and seed.
MIN_K, MAX_K, DEFAULT_K = 2, 5, 3
RESTARTS, SEED = 10, 42


def _best_model(vectors: DataFrame, k: int, restarts: int, seed: int, workers: int):
    """The fit of lowest cost over several seeds."""

    def fit(s: int):
        return KMeans(k=k, seed=s, featuresCol="features", predictionCol="cluster").fit(vectors)

    with ThreadPoolExecutor(workers) as pool:
        return min(pool.map(fit, range(seed, seed + restarts)), key=lambda m: m.summary.trainingCost)


def kmeans_select_k(
    table: DataFrame,
    features: list[str],
    *,
    max_k: int = MAX_K,
    restarts: int = RESTARTS,
    seed: int = SEED,
    workers: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """(table with ``cluster``, silhouette per k with the chosen one marked).

    k runs from 2 to ``max_k`` (fewer for tiny tables); the best silhouette
    wins, the smaller k on a tie. The silhouette is the squared-Euclidean one,
    which needs one pass; the pairwise Euclidean form would be quadratic.
    """
    rows = table.count()
    if rows < 3:
        raise ValueError("segmentation needs at least three entities")
    keyed = minmax_scale(table.withColumn("_raw", F.struct(*table.columns)), features)
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(keyed)
    stored = materialise(assembled.select("features", *[F.col(f"_raw.{c}").alias(c) for c in table.columns]), "vectors")
    vectors = stored.select("features")

    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    models, scores = {}, {}
    for k in range(MIN_K, min(max_k, rows - 1) + 1):
        models[k] = _best_model(vectors, k, restarts, seed, workers)
        scores[k] = evaluator.evaluate(models[k].transform(vectors))
    best = max(scores, key=lambda k: (scores[k], -k)) if scores else DEFAULT_K
    labelled = models[best].transform(stored).drop("features")
    report = table.sparkSession.createDataFrame(
        [(k, float(s), k == best) for k, s in scores.items()], "k int, silhouette double, chosen boolean"
    )
    return labelled, report


def name_segments(df: DataFrame, rank_by: str, cluster: str = "cluster", alias: str = "segment") -> DataFrame:
    """Name each cluster by the mean of ``rank_by``: best, worst, and the ones between.

    The names (one row per cluster) are joined back.
    """
    means = df.groupBy(cluster).agg(F.avg(rank_by).alias("_mean"))
    order = Window.orderBy(F.desc_nulls_last("_mean"), F.asc(cluster))  # one row per cluster
    everything = Window.partitionBy()
    named = means.select(
        cluster,
        F.when(F.row_number().over(order) == 1, SEGMENT_BEST)
        .when(F.row_number().over(order) == F.count(F.lit(1)).over(everything), SEGMENT_WORST)
        .otherwise(SEGMENT_MIDDLE)
        .alias(alias),
    )
    return df.join(named, cluster)


def segment_profile(
    df: DataFrame, features: list[str], *, segment: str = "segment", rename: dict[str, str] | None = None,
    digits: int | None = 2,
) -> DataFrame:
    """Per segment: mean of each feature and number of entities."""
    names = rename or {}
    return df.groupBy(segment).agg(
        *[round_even(F.avg(c), digits).alias(names.get(c, c)) for c in features],
        F.count(F.lit(1)).alias("student_count"),
    )


def segment_members(df: DataFrame, entity: str, name: str | None, columns: list[str], segment: str = "segment") -> DataFrame:
    """Entity, segment, some measures and a display name (the id if it has none)."""
    shown = F.coalesce(F.col(name).cast("string"), F.col(entity).cast("string")) if name else F.col(entity).cast("string")
    return df.select(entity, segment, *columns, shown.alias("display_name"))
