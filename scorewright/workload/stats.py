"""Exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.functions.numbers import round_even
from scorewright.operators import statistics as S
from scorewright.presets import CORRELATION_TESTS
from scorewright.workload.frames import MEASURES_CTE, RECORDS_CTE, measures, r6, records, table, union_sql

VARIABLES = [v for v, _ in CORRELATION_TESTS]
TARGET = "current_gpa"


def histogram(spark, sf_dir):
    return S.histogram(measures(spark, sf_dir), ["quantity", "price", "tax"], digits=6)


def histogram_events(spark, sf_dir):
    """Heavy-tailed values: most bins are nearly empty."""
    return S.histogram(table(spark, sf_dir, "events"), ["value"], 25, digits=6)


def iqr_outliers(spark, sf_dir):
    return S.iqr_outliers(table(spark, sf_dir, "events"), "value", ["event_id", "user_id", "value"])


def iqr_outliers_none(spark, sf_dir):
    """Evenly spread values have no outliers: a count of zero."""
    found = S.iqr_outliers(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_quantity"])
    return found.agg(F.count(F.lit(1)).alias("outliers"))


def _rounded(df, *columns):
    return df.withColumns({c: round_even(F.col(c), 6) for c in columns})


def correlate_pearson(spark, sf_dir):
    return _rounded(S.correlate_pearson(records(spark, sf_dir), VARIABLES, TARGET), "pearson_coef", "pearson_t")


def correlate_spearman(spark, sf_dir):
    return _rounded(S.correlate_spearman(records(spark, sf_dir), VARIABLES, TARGET), "spearman_coef", "spearman_t")


def classify_correlation(spark, sf_dir):
    """Verdicts; the p-value itself has no SQL form, its comparison with 5 % has."""
    tested = S.correlate_pearson(records(spark, sf_dir), [*VARIABLES, "final_exam", "assignment_score", "previous_gpa"], TARGET)
    judged = S.classify_correlation(tested.withColumn("pearson_p_value", S.t_test_p("pearson_t", "n")))
    decision = F.regexp_extract("hypothesis_summary", r"Decision: (.*) \(p-value", 1)
    return judged.select("variable", "significant", "interpretation", decision.alias("decision"))


def correlation_p_values(spark, sf_dir):
    tested = S.correlate_pearson(records(spark, sf_dir), VARIABLES, TARGET)
    return tested.withColumn("pearson_p_value", S.t_test_p("pearson_t", "n"))


QUERIES = {
    "histogram": histogram,
    "histogram_events": histogram_events,
    "iqr_outliers": iqr_outliers,
    "iqr_outliers_none": iqr_outliers_none,
    "correlate_pearson": correlate_pearson,
    "correlate_spearman": correlate_spearman,
    "classify_correlation": classify_correlation,
    "correlation_p_values": correlation_p_values,
}


def histogram_sql(columns: dict[str, str], source: str, bins: int = 10) -> str:
    """``columns``: measure name -> column. Bins by edge comparison, empty ones included."""
    long = union_sql([f"select '{m}' as measure, {c} as value from {source} where {c} is not null" for m, c in columns.items()])
    return f"""
        long as ({long}),
        ends as (select measure, min(value) as lo, max(value) as hi from long group by measure),
        grid as (select measure, b, lo + b * ((hi - lo) / {bins}) as bin_from,
                        case when b = {bins - 1} then hi else lo + (b + 1) * ((hi - lo) / {bins}) end as bin_to
                 from ends, range({bins}) t(b)),
        counts as (select g.measure, g.b, count(*) as n from grid g join long l on l.measure = g.measure
                   and l.value >= g.bin_from and (l.value < g.bin_to or (g.b = {bins - 1} and l.value <= g.bin_to)) group by all)
        select g.measure, g.b + 1 as bin, {r6('bin_from')} as bin_from, {r6('bin_to')} as bin_to, coalesce(n, 0) as count
        from grid g left join counts c on g.measure = c.measure and g.b = c.b
    """


OUTLIERS_SQL = """
    fences as (select q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high
               from (select quantile_cont({v}, 0.25) as q1, quantile_cont({v}, 0.75) as q3 from {t}))
"""


def _pearson(variable: str) -> str:
    return (
        f"select '{variable}' as variable, count(*) as n, corr({variable}, {TARGET}) as r from records "
        f"where {variable} is not null and {TARGET} is not null"
    )


def _spearman(variable: str) -> str:
    def ranks(c: str) -> str:
        return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double"

    return (
        f"select '{variable}' as variable, count(*) as n, corr(rx, ry) as r from (select {ranks(variable)} as rx, "
        f"{ranks(TARGET)} as ry from records where {variable} is not null and {TARGET} is not null)"
    )


_T = "abs(r) * sqrt((n - 2) / (1 - r * r))"
ORACLES = {
    "histogram": f"with {MEASURES_CTE}, " + histogram_sql({"quantity": "quantity", "price": "price", "tax": "tax"}, "m"),
    "histogram_events": "with " + histogram_sql({"value": "value"}, "events", 25),
    "iqr_outliers": f"with {OUTLIERS_SQL.format(v='value', t='events')} select event_id, user_id, value from events "
    "where value < (select low from fences) or value > (select high from fences)",
    "iqr_outliers_none": f"with {OUTLIERS_SQL.format(v='l_quantity', t='lineitem')} select count(*) as outliers from lineitem "
    "where l_quantity < (select low from fences) or l_quantity > (select high from fences)",
    "correlate_pearson": f"with {RECORDS_CTE}, c as ({union_sql([_pearson(v) for v in VARIABLES])}) "
    f"select variable, n, {r6('r')} as pearson_coef, {r6(_T)} as pearson_t from c",
    "correlate_spearman": f"with {RECORDS_CTE}, c as ({union_sql([_spearman(v) for v in VARIABLES])}) "
    f"select variable, n, {r6('r')} as spearman_coef, {r6(_T)} as spearman_t from c",
    # for thousands of rows the 5 % bound of |t| is 1.96
    "classify_correlation": f"with {RECORDS_CTE}, c as ("
    + union_sql([_pearson(v) for v in [*VARIABLES, "final_exam", "assignment_score", "previous_gpa"]])
    + f"), s as (select variable, r, {_T} > 1.96 as significant from c) select variable, significant, "
    "case when significant and r > 0.6 then 'Strong positive linear correlation' "
    "when significant and r > 0.3 then 'Moderate positive correlation' when significant then 'Weak correlation' "
    "else 'No statistically significant correlation' end as interpretation, "
    "case when significant then 'Reject H0' else 'Fail to Reject H0' end as decision from s",
}
