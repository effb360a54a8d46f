"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

A bounded sample of labelled documents (``per_label`` of each label, by a hash of the id) trains a forest of shallow
trees; every path from a root to a node becomes a rule, and a lasso logistic regression over the rules keeps few of
them. The kept rules are compiled into one Spark column expression, so scoring is a projection: one scan of the
texts, no shuffle, no Python.

Defined cases: a null text is empty and gets a score like any other. Null ids are held out and scored. Rows with
null labels are not learned from; a document labelled twice counts once, with its lower label. With labels of one
kind, or none, every document gets the smoothed share of label 1. Other columns are ignored. An empty table gives no
rows.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from scorewright.llm.common import held_out
from scorewright.llm.weak_rules import text_counts
from scorewright.session import materialise

PER_LABEL = 4_000
ACCEPT = 0.3
ITERATIONS = 200  # more than the lasso needs to converge
#: Statistic: expression over the counts of a text.
STATISTICS = {
    "n_words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "n_symbols": "n_symbols",
    "marked": "n_marked / greatest(n_words, 1)",
    "n_marked": "n_marked",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
}
Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", threshold), all of which must hold


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics, in one pass over the texts."""
    return text_counts(docs).select("doc_id", *[F.expr(e).cast("double").alias(f"s_{n}") for n, e in STATISTICS.items()])


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of labelled ids that are not held out, with their lower label."""
    return labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """(doc_id, y, weight) of at most ``per_label`` labelled ids of each label, none held out.

    ``weight`` is how many labelled documents a sampled one stands for.
    """
    known = materialise(known_labels(labels, label), "labels")
    totals = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
             .withColumn("weight", F.lit(max(1.0, n / per_label))) for y, n in sorted(totals.items())]
    if not parts:
        return known.withColumn("weight", F.lit(1.0))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_BRANCH = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_rules(description: str, names: list[str]) -> list[Rule]:
    """The path to every node of a tree, read from its printed form."""
    rules, path = [], []
    for line in description.splitlines():
        if m := _BRANCH.match(line):
            depth = len(m[1])
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, (names[int(m[2])], m[3], float(m[4]))))
            rules.append(_tight([c for _, c in path]))
    return rules


def _tight(conditions) -> Rule:
    """One condition per statistic and side: the narrowest."""
    best: dict[tuple[str, str], float] = {}
    for name, side, at in conditions:
        narrower = min if side == "<=" else max
        best[name, side] = narrower(at, best.get((name, side), at))
    return tuple(sorted((n, s, a) for (n, s), a in best.items()))


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, side, at in rule:
        out = out & ((F.col(f"s_{name}") <= at) if side == "<=" else (F.col(f"s_{name}") > at))
    return out


def fit_rules(sample: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.002,
              seed: int = 7, iterations: int = ITERATIONS) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and the weighted rules that the lasso keeps; ``sample`` has statistics, y and weight."""
    names = list(STATISTICS)
    ready = VectorAssembler(inputCols=[f"s_{n}" for n in names], outputCol="x_").transform(sample).select("x_", "y", "weight")
    forest = RandomForestClassifier(featuresCol="x_", labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed,
                                    featureSubsetStrategy="onethird").fit(ready)
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree.toDebugString, names)})
    held = sample.select("y", "weight", *[condition(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x_").transform(held)
    model = LogisticRegression(featuresCol="x_", labelCol="y", weightCol="weight", elasticNetParam=1.0, regParam=penalty,
                               maxIter=iterations).fit(materialise(held.select("x_", "y", "weight").coalesce(2), "rules"))
    return model.intercept, [(r, w) for r, w in zip(rules, model.coefficients.toArray().tolist()) if w]


def score_column(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    odds = F.lit(intercept)
    for rule, weight in rules:
        odds = odds + F.when(condition(rule), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Column:
    """The score as a column over ``statistics``."""
    chosen = labelled_sample(docs, labels, "quality", per_label)
    sample = materialise(statistics(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
                         .join(F.broadcast(chosen), "doc_id"), "quality-sample").coalesce(4)
    shares = {r.y: r.w for r in sample.groupBy("y").agg(F.sum("weight").alias("w")).collect()}
    if len(shares) < 2:
        return F.lit((shares.get(1.0, 0.0) + 1) / (sum(shares.values()) + 2))
    return score_column(*fit_rules(sample))


def score_quality(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    score = fit(docs, labels, per_label)
    scored = statistics(docs).select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """The rows of ``docs`` that are not rejected, as they are."""
    score = fit(docs, labels, per_label)
    wrapped = docs.select(F.struct("*").alias("doc_id"), F.col("text"))  # the row passes through in the id's place
    # a row number keeps the filter above the statistics: pushed below, each rule would compute them again
    judged = statistics(wrapped).select("doc_id", (score >= ACCEPT).alias("kept"), F.monotonically_increasing_id().alias("row"))
    return judged.where("kept and row >= 0").select("doc_id.*")
