"""Registered composite reports (EDA-21/22, DEC-12) and IO round trips (IO-1..4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import sampling as S
from ..operators import training as T
from ..session import cut_lineage
from ..sources import fixtures as X
from ..sources.fixtures import CATEGORICAL, NUMERIC, TARGET
from ..sources.io import read_table, write_splits, write_table
from . import reports as R
from . import profile_queries as PQ
from .catalog import REGISTRY, Query, register
from .feature_queries import _split_sql
from .decision_queries import _TRADEOFF_CTES, IMPACT_FLOATS, MONEY, _DECISION_SQL, _impact_sql

LOAN_COLS = NUMERIC + CATEGORICAL + [TARGET]



def _rounded(r):
    """Large values share a column with rates: summation order moves their last
    bits, so they are compared at fewer decimals."""
    v, size = F.col("value"), F.abs(F.col("value"))
    return r.withColumn("value", F.when(size >= 1e6, F.round(v, 0)).when(size >= 1e3, F.round(v, 2)).otherwise(F.round(v, 5)) + 0.0)


_ROUNDED = ("SELECT section, feature, metric, CASE WHEN abs(value) >= 1e6 THEN round(value, 0) WHEN abs(value) >= 1e3 THEN round(value, 2) "
            "ELSE round(value, 5) END + 0.0 AS value FROM (\n{}\n) u")


def _long_sql(src: str, section: str, feature: str | None, metrics: list[str]) -> str:
    f = f"CAST({feature} AS VARCHAR)" if feature else "CAST(NULL AS VARCHAR)"
    return "\nUNION ALL ".join(f"SELECT '{section}' AS section, {f} AS feature, '{m}' AS metric, "
                               f"CAST({m} AS DOUBLE) AS value FROM {src}" for m in metrics)


def _body(name: str) -> str:
    """SQL of a registered query as a table of its own."""
    q = REGISTRY[name]
    return f"({f'WITH {q.ctes} ' if q.ctes else ''}{q.sql})"


_STATS = ["count", "mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis"]
_EDA_PARTS = {
    "sh": "(SELECT count(*) AS rows FROM applications)", "ds": _body("describe_applications"),
    "bc": f"(SELECT *, feature || '=' || {TARGET} AS key FROM ({PQ._by_class_sql('applications', NUMERIC, TARGET)}) t)",
    "co": f"(SELECT f1 || '|' || f2 AS pair, corr FROM ({PQ._corr_sql('applications', NUMERIC)}) t)",
    "tg": _body("target_distribution"), "iv": _body("information_value"), "au": _body("univariate_auc"), "vi": _body("vif"),
}
# the view has no NULLs, so the section of missing values is empty
register(Query(
    "eda_report", lambda spark, sf: _rounded(R.eda_report(X.applications(spark, sf).select(*LOAN_COLS), TARGET)),
    operators="EDA-21", ctes=",\n".join(f"{n} AS MATERIALIZED {b}" for n, b in _EDA_PARTS.items()),
    sql=_ROUNDED.format("\nUNION ALL ".join([
        _long_sql("sh", "shape", None, ["rows"]), _long_sql("ds", "distribution", "feature", _STATS),
        _long_sql("bc", "by_class", "key", ["min", "q25", "median", "q75", "max", "mean"]), _long_sql("co", "correlation", "pair", ["corr"]),
        _long_sql("tg", "target", "target", ["count", "pct"]), _long_sql("iv", "information_value", "feature", ["iv"]),
        _long_sql("au", "roc_auc", "feature", ["roc_auc"]), _long_sql("vi", "vif", "feature", ["vif"])]))))


def _eda_written(spark, sf):
    """IO-3: the EDA summary (the ten highest information values and AUCs, the
    other sections in full) as JSON lines, read back."""
    return _rounded(R.eda_summary(X.applications(spark, sf).select(*LOAN_COLS), TARGET, R.scratch(spark, "eda")))


def _top_ten(table: str, metric: str) -> str:
    return f"(SELECT * FROM {table} ORDER BY {metric} DESC, feature LIMIT 10)"


register(Query(
    "eda_summary_written", _eda_written, operators="IO-3 EDA-21", ctes=",\n".join(f"{n} AS MATERIALIZED {b}" for n, b in _EDA_PARTS.items()),
    sql=_ROUNDED.format("\nUNION ALL ".join([
        _long_sql("sh", "shape", None, ["rows"]), _long_sql("tg", "target", "target", ["count", "pct"]),
        _long_sql(_top_ten("iv", "iv"), "information_value", "feature", ["iv"]),
        _long_sql(_top_ten("au", "roc_auc"), "roc_auc", "feature", ["roc_auc"]), _long_sql("vi", "vif", "feature", ["vif"])]))))

_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LI_CAT = ["l_linestatus", "l_shipdate"]
_LI_PARTS = {
    "ov": "(SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS c FROM lineitem GROUP BY ALL))"
          .replace("GROUP BY ALL", "GROUP BY " + ", ".join([*_LI_NUM, "l_returnflag", *_LI_CAT])),
    "mi": '(SELECT * FROM (' + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS missing, round(count_if({c} IS NULL) * 100.0 / count(*), 2) AS pct FROM lineitem"
        for c in [*_LI_NUM, "l_returnflag", *_LI_CAT]) + ") t WHERE missing > 0)",
    "ds": f"({PQ._describe_sql('lineitem', _LI_NUM)})", "iq": f"({PQ._iqr_sql('lineitem', _LI_NUM)})",
    "zs": f"({PQ._z_sql('lineitem', _LI_NUM)})",
    "tc": f"(SELECT f1 || '|' || f2 AS pair, corr FROM ({PQ._corr_sql('lineitem', _LI_NUM)}) c JOIN (VALUES "
          + ", ".join(f"('{c}', {i})" for i, c in enumerate(_LI_NUM)) + ") a(f, p) ON f1 = a.f JOIN (VALUES "
          + ", ".join(f"('{c}', {i})" for i, c in enumerate(_LI_NUM)) + ") b(f, p) ON f2 = b.f WHERE a.p > b.p ORDER BY abs(corr) DESC, a.p, b.p LIMIT 10)",
    "ca": "(" + " UNION ALL ".join(f"SELECT '{c}=' || CAST({c} AS VARCHAR) AS fv, count(*) AS count FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}"
                                   for c in _LI_CAT) + ")",
    "tg": "(SELECT l_returnflag AS target, count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM lineitem GROUP BY l_returnflag)",
}
register(Query(
    "profile_report_lineitem",
    lambda spark, sf: _rounded(R.profile_report(X.read_parquet(spark, f"{sf}/lineitem.parquet"), target="l_returnflag")),
    operators="EDA-22", ctes=",\n".join(f"{n} AS MATERIALIZED {b}" for n, b in _LI_PARTS.items()),
    sql=_ROUNDED.format("\nUNION ALL ".join([
        _long_sql("ov", "overview", None, ["n_rows", "n_duplicates"]), _long_sql("mi", "missing", '"column"', ["missing", "pct"]),
        _long_sql("ds", "describe", "feature", _STATS), _long_sql("iq", "iqr_outliers", "feature", ["n_outliers"]),
        _long_sql("zs", "zscore", "feature", ["n_extreme"]), _long_sql("tc", "top_corr", "pair", ["corr"]),
        _long_sql("ca", "categories", "fv", ["count"]), _long_sql("tg", "target", "target", ["count", "pct"])]))))


def _decision_report(spark, sf):
    # money sums (~1e9) and rates share one column: money is compared at 2
    # decimals (summation order moves its last bits), everything else at 6
    r = R.decision_report(X.scored(spark, sf))
    v = F.col("value")
    return r.withColumn("value", F.when(F.abs(v) >= F.lit(1e6), F.round(v, 2)).otherwise(F.round(v, 6)))


_SEG = ("CASE WHEN risk_score < 2e-1 THEN 'Very Low Risk' WHEN risk_score < 4e-1 THEN 'Low Risk' "
        "WHEN risk_score < 6e-1 THEN 'Medium Risk' WHEN risk_score < 8e-1 THEN 'High Risk' ELSE 'Very High Risk' END")
_REPORT_CTES = (f"decided AS (SELECT *, {_DECISION_SQL} AS decision FROM scored),\n"
                f"imp AS ({_impact_sql('decided')}),\n" + _TRADEOFF_CTES + ",\n"
                f"trade AS ({_impact_sql('swept', 'pair_id, approve_threshold, reject_threshold')}),\n"
                f"seg AS (SELECT {_SEG} AS risk_segment, count(*) AS count, avg(risk_score) AS mean_score, "
                "min(risk_score) AS min_score, max(risk_score) AS max_score, "
                "avg(CAST(defaulted AS DOUBLE)) AS actual_default_rate FROM scored GROUP BY 1),\n"
                "th AS (SELECT 0.3 AS approve, 0.7 AS reject)")
_REPORT_SQL = ("SELECT section, feature, metric, CASE WHEN abs(value) >= 1e6 THEN round(value, 2) "
               "ELSE round(value, 6) END + 0.0 AS value FROM (\n"
               + "\nUNION ALL ".join([
                   _long_sql("th", "thresholds", None, ["approve", "reject"]),
                   _long_sql("imp", "business_impact", None, D.IMPACT_COLS),
                   _long_sql("trade", "tradeoff", "pair_id", ["approve_threshold", "reject_threshold", "approval_rate",
                                                              "default_rate_in_approved", "false_negative_rate",
                                                              "approved_count"]),
                   _long_sql("seg", "segments", "risk_segment", ["count", "mean_score", "min_score", "max_score",
                                                                 "actual_default_rate"])]) + "\n) u")

register(Query(
    "decision_report", _decision_report, operators="DEC-12", ctes=_REPORT_CTES, sql=_REPORT_SQL))

register(Query(
    "csv_round_trip", lambda spark, sf: R.csv_round_trip(spark, X.applications(spark, sf).select(*LOAN_COLS)),
    operators="IO-1 IO-2", floats=["Income", "LoanAmount"],
    sql="SELECT " + ", ".join(LOAN_COLS) + " FROM applications"))


def _report_write(spark, sf):
    path = R.scratch(spark, "impact") + ".json"
    write_table(D.business_impact(D.apply_policy(X.scored(spark, sf))), path, fmt="json")
    return spark.read.json(path)


register(Query(
    "report_write_json", _report_write, operators="IO-3", floats=IMPACT_FLOATS, digits=MONEY,
    ctes=f"decided AS (SELECT *, {_DECISION_SQL} AS decision FROM scored)", sql=_impact_sql("decided")))


def _csv_table(spark, df, name):
    """IO-3: a report table written as CSV and read back with its own schema."""
    path = R.scratch(spark, name) + ".csv"
    write_table(df, path, fmt="csv")
    return spark.read.schema(df.schema).csv(path, header=True)


register(Query(
    "decision_report_csv", lambda spark, sf: _csv_table(spark, _decision_report(spark, sf), "decision-report"),
    operators="IO-3 DEC-12", ctes=_REPORT_CTES, sql=_REPORT_SQL))


def _written_splits(spark, sf):
    path = R.scratch(spark, "splits")
    write_splits(S.stratified_split(X.applications(spark, sf), TARGET, "app_id", S.SPLIT_701515), path)
    return spark.read.parquet(path).where(F.col("split") == "val").select("app_id", TARGET)


register(Query(
    "written_splits", _written_splits, operators="IO-5",
    ctes=f"sp AS ({_split_sql('applications', [('train', 7000), ('val', 8500), ('test', 10000)])})",
    sql="SELECT app_id, LoanApproved FROM sp WHERE split = 'val'"))


def _save_load(spark, sf):
    sp = cut_lineage(S.stratified_split(X.scored(spark, sf), TARGET, "app_id"))
    m = T.fit_model(sp.where(F.col("split") == "train"), "logistic_regression", NUMERIC, CATEGORICAL)
    path = R.scratch(spark, "model")
    R.save_fitted(m, path)
    back = R.load_fitted(spark, path)
    a = m.score(sp).select("app_id", F.col("probability_default").alias("p1"))
    b = back.score(sp).select("app_id", F.col("probability_default").alias("p2"))
    return a.join(b, "app_id").agg(F.count(F.lit(1)).alias("rows"),
                                   F.max(F.abs(F.col("p1") - F.col("p2"))).alias("max_abs_diff"))


register(Query(
    "model_save_load", _save_load, operators="IO-4", floats=["max_abs_diff"],
    # a lossless round trip: every row scored, identical probabilities
    sql="SELECT count(*) AS rows, CAST(0.0 AS DOUBLE) AS max_abs_diff FROM applications"))
