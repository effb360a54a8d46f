import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.operators import forest, risk as R, segments as G
from scorewright.operators.actions import recommend_actions
from scorewright.operators.features import feature_matrix, minmax_scale
from scorewright.plans import reports as P
from scorewright.presets import Roles
from scorewright.workload import QUERIES


@pytest.fixture(scope="module")
def labelled(spark):
    """Two separable groups of entities, three rows each."""
    rows = spark.range(240).selectExpr(
        "concat('S', id % 80) as student_id", "case when id % 80 < 40 then 60.0 else 90.0 end + (id % 7) as attendance",
        "case when id % 80 < 40 then 35.0 else 80.0 end + (id % 5) as final_exam", "cast(id % 9 as double) as study_hours",
        "case when id % 80 < 40 then 'DECLINING' else 'STABLE' end as performance_trend", "id as seq", "'X' as department",
    )
    return rows


def test_features_and_scaling(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), ("b", 5.0, 8.0)], "e string, x double, y double")
    rows = {r["e"]: (r["x"], r["y"]) for r in feature_matrix(df, "e", ["x", "y", "z"]).collect()}
    assert rows == {"a": (2.0, 8.0), "b": (5.0, 8.0)}
    scaled = {r["e"]: r["y"] for r in minmax_scale(feature_matrix(df, "e", ["x", "y"]), ["x", "y"]).collect()}
    assert scaled == {"a": 0.0, "b": 0.0}
    with pytest.raises(ValueError):
        feature_matrix(df, "e", ["x"])


@pytest.mark.parametrize("name", list(R.TRAINERS))
def test_models_learn_and_repeat(labelled, name):
    features = ["attendance", "study_hours", "final_exam"]
    table = R.risk_label(feature_matrix(labelled, "student_id", features))
    one = {r["student_id"]: r for r in R.score_all(table, features, name).collect()}
    two = {r["student_id"]: r["probability"] for r in R.score_all(table, features, name).collect()}
    assert len(one) == 80
    assert all(0.0 <= r["probability"] <= 1.0 for r in one.values())
    assert {k: round(r["probability"], 9) for k, r in one.items()} == {k: round(p, 9) for k, p in two.items()}
    assert all((r["probability"] > 0.5) == (r["is_at_risk"] == 1) for r in one.values())


def test_one_class_is_refused(labelled):
    table = R.risk_label(feature_matrix(labelled, "student_id", ["attendance", "final_exam"]), {"attendance": 0.0})
    with pytest.raises(ValueError, match="both"):
        R.score_all(table, ["attendance", "final_exam"], R.LOGISTIC)


def test_label_treats_null_as_not_below(spark):
    df = spark.createDataFrame([(None, 80.0), (None, 60.0)], "current_gpa double, attendance double")
    assert [r["is_at_risk"] for r in R.risk_label(df).collect()] == [0, 1]
    with pytest.raises(ValueError):
        R.risk_label(df.select(F.lit(1).alias("other")))


def test_level_uses_the_raw_probability(spark):
    df = spark.createDataFrame([("a", 0.69999), ("b", 0.7), ("c", 0.4), ("d", 0.1)], "e string, probability double")
    got = [(r["risk_probability"], r["risk_level"]) for r in R.risk_bands(df, "e").collect()]
    assert got == [(70.0, "MEDIUM"), (70.0, "HIGH"), (40.0, "MEDIUM"), (10.0, "LOW")]


def test_kmeans(spark):
    rows = [(i, float(c * 50 + i % 3), float(c * 50 + i % 2)) for c in range(3) for i in range(c * 20, c * 20 + 20)]
    table = spark.createDataFrame(rows, "e int, x double, y double")
    labelled, scores = G.kmeans_select_k(table, ["x", "y"], restarts=2)
    report = {r["k"]: (r["silhouette"], r["chosen"]) for r in scores.collect()}
    assert set(report) == {2, 3, 4, 5} and report[3][1] and all(-1 <= s <= 1 for s, _ in report.values())
    named = G.name_segments(labelled, "x")
    got = {r["segment"]: (r["student_count"], r["x"]) for r in G.segment_profile(named, ["x"]).collect()}
    assert got["High Performer"][0] == got["At Risk"][0] == got["Consistent Performer"][0] == 20
    assert got["High Performer"][1] > got["Consistent Performer"][1] > got["At Risk"][1]
    assert labelled.columns == ["e", "x", "y", "cluster"]
    with pytest.raises(ValueError):
        G.kmeans_select_k(table.limit(2), ["x", "y"])


def test_actions(spark):
    rows = [("a", 60.0, 40.0, 30.0, "DECLINING", "HIGH"), ("b", 70.0, 90.0, 80.0, "STABLE", "LOW"), ("c", 90.0, 90.0, 80.0, "STABLE", "LOW"),
            ("d", 90.0, 90.0, 80.0, "STABLE", "MEDIUM"), ("e", None, 40.0, 80.0, "STABLE", "HIGH")]
    df = spark.createDataFrame(rows, "id_ string, attendance double, assignment_completion double, final_exam double, performance_trend string, risk_level string")
    out = recommend_actions(df, "id_").collect()
    by = {}
    for r in out:
        by.setdefault(r["id_"], []).append(r["category"])
    assert by == {
        "a": ["Attendance Support", "Assignment Assistance", "Exam Remediation", "Mentorship Program", "Personalized Intervention"],
        "b": ["Attendance Warning"], "c": ["Academic Enrichment"], "e": ["Assignment Assistance"],
    }
    assert out[0]["recommendation_text"] == "Critical: Attendance is low at 60.0%. Recommend academic counseling."
    assert {r["status"] for r in out} == {"PENDING"} and len({r["id"] for r in out}) == len(out)
    bare = recommend_actions(df.select("id_", "risk_level"), "id_").collect()
    assert {(r["id_"], r["category"]) for r in bare} == {("b", "Academic Enrichment"), ("c", "Academic Enrichment")}


def test_early_warning(labelled):
    roles = Roles(order=["seq"])
    applied = P.apply_model(labelled, R.LOGISTIC, roles)
    cards = P.report_early_warning(applied["predictions"], labelled, applied["actions"], roles)
    risk = cards["risk_list"].collect()
    assert [r["risk_probability"] for r in risk] == sorted((r["risk_probability"] for r in risk), reverse=True)
    assert {r["department"] for r in risk} == {"X"} and {r["semester"] for r in risk} == {1}
    levels = cards["levels"].first()
    assert sum(levels) == 80
    panel = P.entity_panel(cards, "S3", roles)
    assert panel["risk_list"].count() == panel["indicators"].count() == 1
    alone = P.report_early_warning(applied["predictions"], None, applied["actions"], roles)
    assert alone["risk_list"].first()["student_name"].startswith("S") and "indicators" not in alone


def test_registered_model_queries(spark, sf_dir):
    metrics = {r["model"]: r for r in QUERIES["train_models"](spark, sf_dir).collect()}
    assert set(metrics) == set(R.TRAINERS)
    for r in metrics.values():
        assert 0.5 < r["roc_auc"] <= 1.0 and 0.5 < r["accuracy"] <= 1.0
    assert metrics[R.FOREST]["accuracy"] > 0.9  # the label is a function of the features
    silhouettes = QUERIES["kmeans_select_k"](spark, sf_dir).collect()
    assert sum(r["chosen"] for r in silhouettes) == 1
    importance = QUERIES["feature_importance"](spark, sf_dir).collect()
    assert len(importance) == 18


def test_models_apply_in_a_session_with_observed_writes(spark, labelled):
    """An observation leaves something unserialisable in the session; models must not carry it along."""
    from pyspark.sql import Observation

    seen = Observation("seen")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    table = R.risk_label(feature_matrix(labelled, "student_id", ["attendance", "final_exam"]))
    for name in R.TRAINERS:
        assert R.score_all(table, ["attendance", "final_exam"], name).count() == 80


@pytest.fixture(scope="module")
def noisy(spark):
    return spark.range(8000).selectExpr(
        "concat('S', id) as student_id", "cast(id % 97 as double) as attendance", "cast(id % 89 as double) as final_exam",
        "cast(id % 97 < 40 or hash(id) % 5 = 0 as int) as is_at_risk",
    )


@pytest.mark.parametrize("entity", ["student_id", None])
def test_forest_does_not_depend_on_the_files(noisy, entity):
    def trained(rows):
        model = R.train_forest(rows, ["attendance", "final_exam"], depth=4, **({"entity": entity} if entity else {}))
        return model.toDebugString.split("\n", 1)[1]

    assert trained(noisy.coalesce(1)) == trained(noisy.repartition(5))


@pytest.mark.parametrize("name", list(R.TRAINERS))
def test_training_rows_of_one_file_are_dealt_evenly(noisy, monkeypatch, name):
    class Seen(Exception):
        pass

    def fit(self, rows, params=None):
        raise Seen(rows.rdd.glom().map(len).collect(), self.hasParam("cacheNodeIds") and self.getOrDefault("cacheNodeIds"))

    for estimator in (R.LogisticRegression, R.RandomForestClassifier, R.GBTClassifier):
        monkeypatch.setattr(estimator, "fit", fit)
    with pytest.raises(Seen) as seen:
        R.TRAINERS[name](noisy.coalesce(1), ["attendance", "final_exam"])
    sizes, cached = seen.value.args
    assert sum(sizes) == 8000 and len(sizes) == 16 and max(sizes) < 2 * 8000 / 16
    assert cached == (name == R.FOREST)  # deep trees are not walked from the root at each level


@pytest.mark.parametrize("query", ["train_models", "feature_importance"])
def test_models_train_side_by_side(spark, sf_dir, monkeypatch, query):
    """Each training waits for the others to have begun; results keep the order of the trainers."""
    begun = threading.Barrier(len(R.TRAINERS), timeout=60)

    def met(trainer):
        def run(*args, **options):
            begun.wait()
            return trainer(*args, **options)

        return run

    for name, trainer in list(R.TRAINERS.items()):
        monkeypatch.setitem(R.TRAINERS, name, met(R.train_logistic if name == R.FOREST else trainer))
    names = [r["model"] for r in QUERIES[query](spark, sf_dir).collect()]
    assert list(dict.fromkeys(names)) == list(R.TRAINERS)


def test_a_failing_training_is_reported(noisy, monkeypatch):
    def fails(*args, **options):
        raise ValueError("no forest")

    monkeypatch.setitem(R.TRAINERS, R.FOREST, fails)
    with pytest.raises(ValueError, match="no forest"):
        list(R.train_all(noisy, ["attendance", "final_exam"]))


def test_forest_applies_without_a_stored_copy(noisy, monkeypatch):
    """Saving and loading costs the driver more than applying the forest, and changes no probability."""
    stored = R._stored
    monkeypatch.setattr(R, "_stored", lambda model: pytest.fail("the forest was saved"))
    model = R.train_forest(noisy, ["attendance", "final_exam"], depth=6)
    assert not model.hasSummary
    again = {r["student_id"]: r["probability"] for r in R.predict(stored(model), noisy, ["attendance", "final_exam"]).collect()}
    assert again == {r["student_id"]: r["probability"] for r in R.predict(model, noisy, ["attendance", "final_exam"]).collect()}


FEATURES = ["attendance", "final_exam"]


def _shares(model, rows, features=FEATURES):
    return {r["student_id"]: r["probability"] for r in R.predict(model, rows, features).collect()}


def test_forest_of_many_rows_is_not_grown_by_passes(noisy, monkeypatch):
    spark_s = R.train_forest(noisy, FEATURES, depth=8, entity="student_id")
    monkeypatch.setattr(R, "FOREST_PASS_ROWS", 1000)
    monkeypatch.setattr(R.RandomForestClassifier, "fit", lambda *a, **k: pytest.fail("a pass for each level"))
    grown = R.train_forest(noisy, FEATURES, depth=8, entity="student_id")
    assert grown.getNumTrees == R.FOREST_TREES
    of, own = _shares(spark_s, noisy), _shares(grown, noisy)
    assert own.keys() == of.keys() and sum(abs(own[k] - of[k]) for k in of) / len(of) < 0.05
    assert sum((own[k] > 0.5) == (of[k] > 0.5) for k in of) > 0.98 * len(of)
    assert [r["feature"] for r in R.feature_importance(grown, FEATURES).collect()] == FEATURES
    assert max(abs(grown.featureImportances.toArray() - spark_s.featureImportances.toArray())) < 0.1


def test_grown_forest_depends_neither_on_files_nor_on_tasks(noisy, monkeypatch):
    monkeypatch.setattr(R, "FOREST_PASS_ROWS", 1000)
    plain = R.train_forest(noisy.coalesce(1), FEATURES, entity="student_id")
    want = _shares(plain, noisy)
    for name, value in {"TASK_NODE_ROWS": 500, "SENT_NODES": 1000, "WAVE_BYTES": 500_000, "CHUNK_NODES": 7}.items():
        monkeypatch.setattr(forest, name, value)
    other = R.train_forest(noisy.repartition(5), FEATURES, entity="student_id")
    assert len(other.turns()) > 1 and other.table.where("root > 1").count() > 100
    got = _shares(other, noisy)
    assert {k: round(p, 12) for k, p in got.items()} == {k: round(p, 12) for k, p in want.items()}
    assert abs(other.featureImportances.toArray() - plain.featureImportances.toArray()).max() < 1e-9


def test_trees_of_grown_forest_like_plain_trees(spark):
    """Each tree against one that is grown row by row, node by node."""
    rng = np.random.default_rng(5)
    codes, w = rng.integers(0, 5, (4, 300)).astype(np.uint8), rng.integers(1, 4, 300).astype(np.uint8)
    y = ((codes[0] > 2) ^ (rng.random(300) < 0.2)).astype(np.uint8)

    def gini(rows):
        n, one = w[rows].sum(), w[rows][y[rows] == 1].sum()
        return 2 * one * (n - one) / n

    def plain(node, rows):
        one, n = w[rows][y[rows] == 1].sum(), w[rows].sum()
        best = (1e-9, None, None)
        for f in np.flatnonzero(forest._chosen(np.array([node]), 4, 42, 3)[0]) if node.bit_length() <= 6 else []:
            for cut in range(4):
                left = codes[f][rows] <= cut
                if left.any() and not left.all() and gini(rows) - gini(rows[left]) - gini(rows[~left]) > best[0] + 1e-9:
                    best = (gini(rows) - gini(rows[left]) - gini(rows[~left]), f, cut)
        if best[1] is None:
            return {node: (-1, one / n)}
        left = codes[best[1]][rows] <= best[2]
        out = plain(2 * node, rows[left]) | plain(2 * node + 1, rows[~left])
        ends = [out[2 * node], out[2 * node + 1]]
        if all(f < 0 for f, _ in ends) and (ends[0][1] > 0.5) == (ends[1][1] > 0.5):
            return {node: (-1, one / n)}
        return out | {node: (best[1], one / n)}

    ids, feature, _, counts, _ = forest._subtree(codes + 32 * y, w, 1, 6, 42, 3)
    want = plain(1, np.arange(300))
    assert len(want) > 15 and {int(i): int(f) for i, f in zip(ids, feature)} == {k: int(f) for k, (f, _) in want.items()}
    assert all(abs(c[1] / c.sum() - want[int(i)][1]) < 1e-12 for i, c in zip(ids, counts))


def test_grown_forest_refuses_null_features(noisy, monkeypatch):
    monkeypatch.setattr(R, "FOREST_PASS_ROWS", 1000)
    with pytest.raises(Exception, match="null or NaN in feature"):
        R.train_forest(noisy.withColumn("final_exam", F.expr("if(student_id = 'S7', null, final_exam)")), FEATURES)
