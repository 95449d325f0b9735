"""Composite reports (EDA-21, EDA-22, DEC-12) and IO round trips (IO-1..4).

Reports are long-form tables ``(section, feature, metric, value)``: every
section is a distributed aggregate; only its small result is unioned."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import literal_table
from ..operators import decisions as D
from ..operators import profile as P
from ..operators import quality as Q
from ..operators.boosting import TREE_PRESETS, Booster
from ..operators.gradient_trees import GradientTrees
from ..operators.features import Preprocessor, SparsePreprocessor
from ..operators.ordered import value_table
from ..operators.training import Fitted, feature_importance
from ..session import ensure_checkpoint_dir
from ..sources.io import LOAN_SCHEMA, nan_to_null, read_table, write_table


def _long(df: DataFrame, section: str, feature: str | None, metrics: list[str]) -> DataFrame:
    f = F.col(feature) if feature else F.lit(None).cast("string")
    return df.select(F.explode(F.array(*[F.struct(F.lit(section).alias("section"), f.cast("string").alias("feature"),
                                                  F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                         for m in metrics])).alias("r")).select("r.*")


def eda_report(df: DataFrame, target: str, numeric: list[str] | None = None,
               categorical: list[str] | None = None) -> DataFrame:
    """EDA-21: missing values of the input; then, with non-finite values as
    NULL and incomplete rows dropped (DQ-12): shape, target distribution,
    distributions, class comparison, correlation matrix, IV, univariate AUC and
    VIF, each section in full."""
    clean = nan_to_null(df).dropna()
    num, cat = Q.split_columns(clean, exclude=[target])
    numeric = numeric or num
    categorical = categorical or cat
    values = value_table(clean, numeric)          # one read for every quantile below
    by_class = P.numeric_by_class(clean, numeric, target) \
        .withColumn("key", F.concat_ws("=", "feature", F.col(target).cast("string")))
    parts = [
        _long(Q.missing_report(nan_to_null(df)), "missing", "column", ["missing", "pct"]),
        _long(clean.agg(F.count(F.lit(1)).alias("rows")), "shape", None, ["rows"]),
        _long(P.describe(clean, numeric, table=values), "distribution", "feature",
              ["count", "mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis"]),
        _long(by_class, "by_class", "key", ["min", "q25", "median", "q75", "max", "mean"]),
        _long(P.correlation_long(clean, numeric).withColumn("pair", F.concat_ws("|", "f1", "f2")), "correlation", "pair", ["corr"]),
        _long(P.target_distribution(clean, target), "target", "target", ["count", "pct"]),
        _long(P.information_value(clean, numeric, categorical, target), "information_value", "feature", ["iv"]),
        _long(P.univariate_auc(clean, numeric, target), "roc_auc", "feature", ["roc_auc"]),
        _long(P.vif(clean, numeric), "vif", "feature", ["vif"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def eda_summary(df: DataFrame, target: str, path: str, top: int = 10) -> DataFrame:
    """IO-3: the summary part of the EDA report, written as JSON lines under
    ``path`` and read back: missing values, shape, target, VIF and the ``top``
    information values and univariate AUCs (ties by name)."""
    r = eda_report(df, target).where(F.col("section").isin("missing", "shape", "target", "information_value", "roc_auc", "vif"))
    rn = F.row_number().over(Window.partitionBy("section").orderBy(F.col("value").desc_nulls_last(), "feature"))
    ranked = F.col("section").isin("information_value", "roc_auc")          # one row per column
    r = r.withColumn("rn", rn).where(~ranked | (F.col("rn") <= top)).drop("rn")
    write_table(r, path, fmt="json")
    return df.sparkSession.read.schema(r.schema).json(path)


def profile_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """EDA-22: schema-free profile: overview -> missing -> describe ->
    outliers -> z-scores -> correlation pairs -> categories -> target."""
    num, cat = Q.split_columns(df, exclude=[target] if target else None)
    parts = [
        _long(Q.duplicate_count(df), "overview", None, ["n_rows", "n_duplicates"]),
        _long(Q.missing_report(df), "missing", "column", ["missing", "pct"]),
    ]
    if num:
        values = value_table(df, num)             # one read for the quantiles of all three sections
        parts += [_long(P.describe(df, num, table=values), "describe", "feature",
                        ["count", "mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis"]),
                  _long(P.iqr_outliers(df, num, table=values), "iqr_outliers", "feature", ["n_outliers"]),
                  _long(P.zscore_outliers(df, num, table=values), "zscore", "feature", ["n_extreme"])]
    if len(num) > 1:
        parts.append(_long(P.top_correlated_pairs(df, num).select(F.concat_ws("|", "f1", "f2").alias("pair"), "corr"),
                           "top_corr", "pair", ["corr"]))
    if cat:
        parts.append(_long(P.category_counts(df, cat).select(F.concat_ws("=", "feature", "value").alias("fv"), "count"),
                           "categories", "fv", ["count"]))
    if target:
        parts.append(_long(P.target_distribution(df, target), "target", "target", ["count", "pct"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decision_report(scored: DataFrame, approve: float = 0.30, reject: float = 0.70,
                    score_col: str = "risk_score", default_col: str = "defaulted",
                    amount_col: str | None = "LoanAmount") -> DataFrame:
    """DEC-12: thresholds, business impact, tradeoff curve and risk segments."""
    dec = D.apply_policy(scored, score_col, approve, reject)
    imp = D.business_impact(dec, default_col=default_col, score_col=score_col, amount_col=amount_col)
    th = literal_table(scored.sparkSession, [(approve, reject)], "approve double, reject double")
    curve = D.tradeoff_curve(scored, score_col, default_col, amount_col) \
        .withColumn("key", F.col("pair_id").cast("string"))
    seg = D.segment_stats(scored, score_col, default_col)
    return (_long(th, "thresholds", None, ["approve", "reject"])
            .unionByName(_long(imp, "business_impact", None, D.IMPACT_COLS))
            .unionByName(_long(curve, "tradeoff", "key", ["approve_threshold", "reject_threshold", "approval_rate",
                                                          "default_rate_in_approved", "false_negative_rate",
                                                          "approved_count"]))
            .unionByName(_long(seg, "segments", "risk_segment", ["count", "mean_score", "min_score", "max_score",
                                                                 "actual_default_rate"])))


# ------------------------------------------------------------------ IO
def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster: ``spark.checkpoint.dir`` is read from the session)."""
    return os.path.join(ensure_checkpoint_dir(spark), "io", f"{name}-{uuid.uuid4().hex[:8]}")


def csv_round_trip(spark: SparkSession, df: DataFrame, name: str = "loans") -> DataFrame:
    """IO-1/IO-2: write CSV with a header (in parallel, one file per task),
    read it back with the explicit loan schema (no inference pass)."""
    path = scratch(spark, name) + ".csv"
    write_table(df, path, fmt="csv")
    return read_table(spark, path, schema=LOAN_SCHEMA if set(LOAN_SCHEMA.fieldNames()) <= set(df.columns) else None)


def write_training(trained, path: str) -> None:
    """IO-3: CV results, per-fold metrics, test evaluation and importance of
    the refitted model as CSV tables."""
    for name, df in (("cv_results", trained.summary), ("cv_folds", trained.folds), ("evaluation", trained.evaluation),
                     ("importance", feature_importance(trained.model))):
        write_table(df, os.path.join(path, f"{name}.csv"), fmt="csv")


def save_fitted(fitted: Fitted, path: str) -> None:
    """IO-4: the Spark ML model with its own writer (trees of ``boosting`` as a
    table of records); the preprocessing state (a few numbers and at most
    ``DENSE_LEVELS`` levels) as one JSON record written by Spark, more levels as
    a table."""
    spark = SparkSession.getActiveSession()
    if isinstance(fitted.model, Booster):
        records = list(enumerate(fitted.model.records()))                # one per tree
        literal_table(spark, records, "part int, record string").write.mode("overwrite").parquet(os.path.join(path, "model"))
    else:
        fitted.model.write().overwrite().save(os.path.join(path, "model"))
    p = fitted.prep
    state = {"kind": fitted.kind, "form": type(fitted.model).__name__, "numeric": p.numeric, "categorical": p.categorical,
             "medians": p.medians, "modes": p.modes, "scaler": p.scaler}
    if isinstance(p, SparsePreprocessor):
        p.index.write.mode("overwrite").parquet(os.path.join(path, "levels"))
        state = json.dumps(state | {"sizes": p.sizes})
    else:
        state = json.dumps(state | {"vocab": p.vocab})
    literal_table(spark, [(state,)], "state string").write.mode("overwrite").json(os.path.join(path, "prep"))


def load_fitted(spark: SparkSession, path: str) -> Fitted:
    st = json.loads(spark.read.json(os.path.join(path, "prep")).first()["state"])
    parts = st["numeric"], st["categorical"], st["medians"], st["modes"], {k: tuple(v) for k, v in st["scaler"].items()}
    if "sizes" in st:
        prep = SparsePreprocessor(*parts, spark.read.parquet(os.path.join(path, "levels")), st["sizes"])
    else:
        prep = Preprocessor(*parts, st["vocab"])
    form = {"Booster": Booster, "GradientTrees": GradientTrees}.get(st.get("form", "Booster" if st["kind"] in TREE_PRESETS else ""))
    if form:
        parts = spark.read.parquet(os.path.join(path, "model")).orderBy("part").collect()
        return Fitted(st["kind"], prep, form.from_records([r["record"] for r in parts]))
    cls = GBTClassificationModel if st["kind"].startswith("gbt") else LogisticRegressionModel
    return Fitted(st["kind"], prep, cls.load(os.path.join(path, "model")))
