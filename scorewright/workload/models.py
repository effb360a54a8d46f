"""Segmentation, risk models, evaluation and actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from scorewright.functions.numbers import round_even
from scorewright.operators import evaluation as E
from scorewright.operators import risk as R
from scorewright.operators import segments as G
from scorewright.operators.actions import recommend_actions
from scorewright.operators.features import feature_matrix, minmax_scale
from scorewright.session import materialise
from scorewright.workload.frames import (
    ORDER, ORDER_BOUNDS, ORDER_FEATURES, ORDER_RECORDS_CTE, order_records, r6, table, union_sql,
)


def _six(df, columns):
    return df.withColumns({c: round_even(F.col(c), 6) for c in columns})


def _features(spark, sf_dir) -> DataFrame:
    """One row per order: mean features, nulls filled, with mean score and main trend."""
    return feature_matrix(
        order_records(spark, sf_dir), "student_id", ORDER_FEATURES, also=["current_gpa"], firsts=["department"],
        label="performance_trend", order=["seq"],
    )


def _labelled(spark, sf_dir) -> DataFrame:
    return R.risk_label(_features(spark, sf_dir), ORDER_BOUNDS)


def feature_table(spark, sf_dir):
    return _six(_features(spark, sf_dir), [*ORDER_FEATURES, "current_gpa"])


def minmax(spark, sf_dir):
    balances = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(7.0).alias("constant"))
    return _six(minmax_scale(balances, ["c_acctbal", "constant"]), ["c_acctbal", "constant"])


def _clustered(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.col("c_acctbal"), F.col("c_mktsegment").alias("cluster")
    )


def name_segments(spark, sf_dir):
    named = G.name_segments(_clustered(spark, sf_dir), "c_acctbal")
    return G.segment_members(named, "c_custkey", "c_name", ["c_acctbal"])


def segment_profile(spark, sf_dir):
    named = G.name_segments(_clustered(spark, sf_dir), "c_acctbal")
    return G.segment_profile(named, ["c_acctbal"], rename={"c_acctbal": "mean_balance"}, digits=6)


def _customer_features(spark, sf_dir) -> DataFrame:
    """One row per customer from its orders: size, value and balance."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("orders"), F.avg("o_totalprice").alias("value")
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return materialise(
        customer.join(orders, F.expr("c_custkey = o_custkey")).select("c_custkey", "c_acctbal", "orders", "value"), "customers"
    )


CUSTOMER_FEATURES = ["c_acctbal", "orders", "value"]


def kmeans_select_k(spark, sf_dir):
    return G.kmeans_select_k(_customer_features(spark, sf_dir), CUSTOMER_FEATURES)[1]


def segment_entities(spark, sf_dir):
    """Clusters named best to worst by balance, and profiled."""
    labelled, _ = G.kmeans_select_k(_customer_features(spark, sf_dir), CUSTOMER_FEATURES)
    return G.segment_profile(G.name_segments(labelled, "c_acctbal"), CUSTOMER_FEATURES)


def risk_label(spark, sf_dir):
    return _labelled(spark, sf_dir).select("student_id", "is_at_risk")


def stratified_split(spark, sf_dir):
    return R.stratified_split(_labelled(spark, sf_dir).select("student_id", "is_at_risk"), "student_id")


def _split(spark, sf_dir) -> DataFrame:
    return materialise(R.stratified_split(_labelled(spark, sf_dir), "student_id"), "split")


def _trained(trainer):
    def run(spark, sf_dir):
        rows = _split(spark, sf_dir)
        model = trainer(rows.where("not is_test"), ORDER_FEATURES, entity="student_id")
        scored = R.predict(model, rows.where("is_test"), ORDER_FEATURES)
        return scored.select("student_id", "is_at_risk", "probability")

    return run


def train_models(spark, sf_dir):
    """Metrics of the three classifiers on the same test rows."""
    rows = _split(spark, sf_dir)
    reports = {}
    for name, model in R.train_all(rows.where("not is_test"), ORDER_FEATURES, entity="student_id"):
        scored = materialise(R.threshold_predictions(R.predict(model, rows.where("is_test"), ORDER_FEATURES)), "scored")
        metrics = E.classification_metrics(scored, "is_at_risk", "prediction")
        auc = E.roc_auc(scored, "is_at_risk", "probability").first()["roc_auc"]
        reports[name] = metrics.select(F.lit(name).alias("model"), "*", F.lit(auc).alias("roc_auc"))
    return reduce(DataFrame.unionByName, [reports[name] for name in R.TRAINERS])


def feature_importance(spark, sf_dir):
    rows = _split(spark, sf_dir).where("not is_test")
    parts = {
        name: R.feature_importance(model, ORDER_FEATURES).withColumn("model", F.lit(name))
        for name, model in R.train_all(rows, ORDER_FEATURES, entity="student_id")
    }
    return reduce(DataFrame.unionByName, [parts[name] for name in R.TRAINERS])


def score_all(spark, sf_dir):
    scored = R.score_all(_labelled(spark, sf_dir), ORDER_FEATURES, R.LOGISTIC, entity="student_id")
    return R.risk_bands(scored, "student_id")


def _scored_lines(spark, sf_dir) -> DataFrame:
    """Every line with a fixed score and label; quantities tie, prices hardly do."""
    return table(spark, sf_dir, "lineitem").select(
        *ORDER, F.expr("case when l_returnflag = 'R' then 1 else 0 end").alias("label"),
        F.expr("l_quantity / 50.0").alias("tied"), F.expr("l_extendedprice / 105000.0").alias("score"),
    )


def threshold_predictions(spark, sf_dir):
    return R.threshold_predictions(_scored_lines(spark, sf_dir), 60.0, "score").select(*ORDER, "prediction")


def _predicted(spark, sf_dir):
    return R.threshold_predictions(_scored_lines(spark, sf_dir), 60.0, "score")


def classification_metrics(spark, sf_dir):
    return E.classification_metrics(_predicted(spark, sf_dir), "label", "prediction", digits=6)


def metrics_undefined(spark, sf_dir):
    """Nothing predicted positive: precision and F1 fall back to 0."""
    none = R.threshold_predictions(_scored_lines(spark, sf_dir), 101.0, "score")
    return E.classification_metrics(none, "label", "prediction", digits=6)


def risk_bands(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr("abs(c_acctbal) / 10000.0").alias("probability"))
    return R.risk_bands(rows, "c_custkey", digits=6)


def _action_rows(spark, sf_dir) -> DataFrame:
    """Per order its mean features, and a level by its value."""
    rows = _features(spark, sf_dir).withColumns({
        # quarters keep the text form of the means away from rounding noise
        "attendance": F.rint(F.col("attendance") * 4) / 4, "final_exam": F.rint(F.col("final_exam") * 4) / 4,
        "assignment_completion": F.rint(F.col("assignment_completion") * 4) / 4,
    })
    return rows.withColumn("risk_level", R.level_of(F.col("quiz_score") / 100.0))


def recommend(spark, sf_dir):
    return recommend_actions(_action_rows(spark, sf_dir), "student_id")


QUERIES = {
    "feature_matrix": feature_table,
    "minmax_scale": minmax,
    "kmeans_select_k": kmeans_select_k,
    "segment_entities": segment_entities,
    "name_segments": name_segments,
    "segment_profile": segment_profile,
    "risk_label": risk_label,
    "stratified_split": stratified_split,
    "train_logistic": _trained(R.train_logistic),
    "train_forest": _trained(R.train_forest),
    "train_boosted": _trained(R.train_boosted),
    "train_models": train_models,
    "feature_importance": feature_importance,
    "score_all": score_all,
    "threshold_predictions": threshold_predictions,
    "classification_metrics": classification_metrics,
    "classification_metrics_undefined": metrics_undefined,
    "confusion_matrix": lambda spark, d: E.confusion_matrix(_predicted(spark, d), "label", "prediction"),
    "roc_curve": lambda spark, d: E.roc_curve(_scored_lines(spark, d), "label", "score", digits=6),
    "roc_curve_ties": lambda spark, d: E.roc_curve(_scored_lines(spark, d), "label", "tied", digits=6),
    "roc_auc": lambda spark, d: E.roc_auc(_scored_lines(spark, d), "label", "score", digits=6),
    "roc_auc_ties": lambda spark, d: E.roc_auc(_scored_lines(spark, d), "label", "tied", digits=6),
    "risk_bands": risk_bands,
    "recommend_actions": recommend,
}

_KEY = ", ".join(ORDER)
_FILLED = ", ".join(f"coalesce({c}, (select median({c}) from rolled)) as {c}" for c in ORDER_FEATURES)
FEATURES_CTE = f"""
    {ORDER_RECORDS_CTE},
    rolled as (select student_id, {', '.join(f'avg({c}) as {c}' for c in [*ORDER_FEATURES, 'current_gpa'])},
                      first(department order by {_KEY}) as department from records group by student_id),
    trends as (select student_id, performance_trend, count(*) as n from records group by student_id, performance_trend
               qualify row_number() over (partition by student_id order by count(*) desc, performance_trend) = 1),
    features as (select student_id, {_FILLED}, current_gpa, department, performance_trend
                 from rolled left join trends using (student_id))
"""
_LABEL = "cast(coalesce(attendance < 70, false) or coalesce(current_gpa < 4, false) as integer)"
_SEGMENTS_CTE = """
    means as (select c_mktsegment, avg(c_acctbal) as m from customer group by 1),
    named as (select c_mktsegment, case when row_number() over (order by m desc, c_mktsegment) = 1 then 'High Performer'
                     when row_number() over (order by m desc, c_mktsegment) = count(*) over () then 'At Risk'
                     else 'Consistent Performer' end as segment from means)
"""
_LINES_CTE = ("lines as (select *, case when l_returnflag = 'R' then 1 else 0 end as label, l_quantity / 50.0 as tied, "
              "l_extendedprice / 105000.0 as score from lineitem), "
              "p as (select label, case when score >= 0.6 then 1 else 0 end as prediction from lines)")
_METRICS = "with {cte}, c as (select count_if(label = 1 and prediction = 1)::double as tp, count_if(label = 0 and prediction = 1)::double as fp, " \
    "count_if(label = 1 and prediction = 0)::double as fn, count_if(label = 0 and prediction = 0)::double as tn from p) select " \
    + r6("(tp + tn) / (tp + fp + fn + tn)") + " as accuracy, " \
    + f"coalesce({r6('tp / nullif(tp + fp, 0)')}, 0) as precision, coalesce({r6('tp / nullif(tp + fn, 0)')}, 0) as recall, " \
    + f"coalesce({r6('2 * tp / nullif(2 * tp + fp + fn, 0)')}, 0) as f1_score from c"


def _roc(score: str) -> str:
    def rate(flag: str) -> str:
        running = f"sum(count_if(label = {flag})) over (order by {score} desc)"
        return r6(f"cast({running} as double) / cast(sum(count_if(label = {flag})) over () as double)")

    return (
        f"with {_LINES_CTE} select {score} as threshold, {rate('0')} as fpr, {rate('1')} as tpr from lines group by {score} "
        "union all select cast('infinity' as double), cast(0 as double), cast(0 as double)"
    )


def _auc(score: str) -> str:
    ranks = f"rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2.0::double"
    return (
        f"with {_LINES_CTE}, r as (select label, {ranks} as rk from lines), "
        "s as (select sum(rk) filter (where label = 1) as rs, count_if(label = 1)::double as p, count_if(label = 0)::double as n from r) "
        f"select {r6('(rs - p * (p + 1) / 2) / (p * n)')} as roc_auc from s"
    )


_QUARTERS = "round_even({} * 4, 0) / 4"
_ACTIONS_SQL = f"""
    with {FEATURES_CTE},
    rows_ as (select student_id, {_QUARTERS.format('attendance')} as attendance, {_QUARTERS.format('final_exam')} as final_exam,
                    {_QUARTERS.format('assignment_completion')} as completion, performance_trend,
                    case when quiz_score / 100.0 >= 0.7 then 'HIGH' when quiz_score / 100.0 >= 0.4 then 'MEDIUM' else 'LOW' end as level
             from features),
    hits as (
        select student_id, 'Attendance Support' as category,
               printf('Critical: Attendance is low at %.1f%%. Recommend academic counseling.', attendance) as recommendation_text
        from rows_ where attendance < 65
        union all select student_id, 'Attendance Warning',
               printf('Warning: Attendance is at %.1f%%. Remind student of attendance limits.', attendance)
        from rows_ where attendance >= 65 and attendance < 75
        union all select student_id, 'Assignment Assistance',
               printf('Critical: Assignment completion is only %.1f%%. Peer tutoring recommended.', completion)
        from rows_ where completion < 50
        union all select student_id, 'Exam Remediation',
               printf('Exam alert: Student exam average is low (%.1f%%). Remediation program suggested.', final_exam)
        from rows_ where final_exam < 40
        union all select student_id, 'Mentorship Program',
               'Declining trend: Performance has declined. Recommend placement in faculty mentorship.'
        from rows_ where performance_trend = 'DECLINING'
    ),
    counted as (select r.student_id, r.level, count(h.category) as n from rows_ r left join hits h using (student_id) group by all),
    everything as (
        select * from hits
        union all select student_id, 'Personalized Intervention',
               'High-Risk Profile: Multiple negative indicators. Urgent counselor meeting recommended.'
        from counted where level = 'HIGH' and n >= 2
        union all select student_id, 'Academic Enrichment',
               'Excellent: Stable performance. Recommend for honors track or peer tutoring role.'
        from counted where level = 'LOW' and n = 0
    )
    select md5(cast(student_id as varchar) || '|' || category) as id, student_id, category, recommendation_text, 'PENDING' as status
    from everything
"""

ORACLES = {
    "feature_matrix": f"with {FEATURES_CTE} select student_id, "
    + ", ".join(f"{r6(c)} as {c}" for c in [*ORDER_FEATURES, "current_gpa"]) + ", department, performance_trend from features",
    "minmax_scale": f"select c_custkey, {r6('(c_acctbal - (select min(c_acctbal) from customer)) / ((select max(c_acctbal) - min(c_acctbal) from customer) + 1e-9)')} as c_acctbal, "
    "cast(0 as double) as constant from customer",
    "name_segments": f"with {_SEGMENTS_CTE} select c_custkey, segment, c_acctbal, c_name as display_name from customer join named using (c_mktsegment)",
    "segment_profile": f"with {_SEGMENTS_CTE} select segment, {r6('avg(c_acctbal)')} as mean_balance, count(*) as student_count "
    "from customer join named using (c_mktsegment) group by segment",
    "risk_label": f"with {FEATURES_CTE} select student_id, {_LABEL} as is_at_risk from features",
    "stratified_split": f"with {FEATURES_CTE}, l as (select student_id, {_LABEL} as is_at_risk, md5('42|' || cast(student_id as varchar)) as h from features) "
    "select student_id, is_at_risk, row_number() over (partition by is_at_risk order by h, student_id) <= "
    "round(0.3 * count(*) over (partition by is_at_risk)) as is_test from l",
    "threshold_predictions": f"with {_LINES_CTE} select {_KEY}, case when score >= 0.6 then 1 else 0 end as prediction from lines",
    "classification_metrics": _METRICS.format(cte=_LINES_CTE),
    "classification_metrics_undefined": _METRICS.format(cte=_LINES_CTE.replace("score >= 0.6", "score >= 1.01")),
    "confusion_matrix": f"with {_LINES_CTE} " + union_sql([
        f"select {a} as actual, {b} as predicted, cast(count_if(label = {a} and prediction = {b}) as bigint) as count from p"
        for a in (0, 1) for b in (0, 1)
    ]),
    "roc_curve": _roc("score"),
    "roc_curve_ties": _roc("tied"),
    "roc_auc": _auc("score"),
    "roc_auc_ties": _auc("tied"),
    "risk_bands": f"with r as (select c_custkey, abs(c_acctbal) / 10000.0 as p from customer) select c_custkey, {r6('p * 100')} as risk_probability, "
    "case when p >= 0.7 then 'HIGH' when p >= 0.4 then 'MEDIUM' else 'LOW' end as risk_level from r",
    "recommend_actions": _ACTIONS_SQL,
}
