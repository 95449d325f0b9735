"""Registered model queries (ML-4..14, SC-1, SC-5, FE-17) on all columns; they
are checked by row counts here and by tests (AUC ranges, parity properties).
``model_check_queries`` has the fits that SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import literal_table
from ..operators import evaluation as V
from ..operators import features as FE
from ..operators import profile as P
from ..operators import sampling as S
from ..operators import scoring as SC
from ..operators import training as T
from ..session import cut_lineage
from ..sources import fixtures as X
from ..sources.fixtures import CATEGORICAL, NUMERIC, TARGET
from . import reports as R
from .catalog import Query, register


def _split(spark, sf):
    # one written copy of the split; every fit below reads that
    return cut_lineage(S.stratified_split(X.scored(spark, sf), TARGET, "app_id"))


def _fit(spark, sf, kind, params=None):
    sp = _split(spark, sf)
    return T.fit_model(sp.where(F.col("split") == "train"), kind, NUMERIC, CATEGORICAL, params=params), sp


def _holdout(kind):
    def build(spark, sf):
        m, sp = _fit(spark, sf, kind)
        te = cut_lineage(m.score(sp.where(F.col("split") == "test")).select("defaulted", "probability_default"))
        return V.evaluation_report(te, "defaulted", "probability_default").withColumn("model", F.lit(kind))
    return build


register(Query("logistic_holdout", _holdout("logistic_regression"), operators="ML-4 ML-7 EV-15"))
register(Query("gbt_holdout", _holdout("gbt"), operators="ML-5 ML-7"))
register(Query("gbt_deep_holdout", _holdout("gbt_deep"), operators="ML-6 ML-7"))


def _folds(spark, sf):
    return cut_lineage(S.stratified_folds(X.scored(spark, sf), TARGET, "app_id"))


def _cv(spark, sf):
    _, fm = T.cross_validate(_folds(spark, sf), "logistic_regression", NUMERIC, CATEGORICAL)
    return fm


register(Query("cross_validate_logistic", _cv, operators="ML-8"))


def _oof(spark, sf):
    oof, _ = T.cross_validate(_folds(spark, sf), "logistic_regression", NUMERIC, CATEGORICAL)
    return oof.select("app_id", "fold", "defaulted",
                      F.col("probability_default").between(0.0, 1.0).alias("is_probability"))


register(Query(
    "oof_predictions", _oof, operators="ML-8",
    # every row predicted exactly once, by the model that has not seen its fold
    ctes="""fd AS (SELECT app_id, defaulted, CAST((row_number() OVER (PARTITION BY LoanApproved
  ORDER BY md5(CAST(app_id AS VARCHAR) || '|42'), app_id) - 1) % 5 AS INTEGER) AS fold FROM scored)""",
    sql="SELECT app_id, fold, defaulted, true AS is_probability FROM fd"))

register(Query(
    "plain_folds", lambda spark, sf: S.plain_folds(X.scored(spark, sf), "app_id").select("app_id", "fold"), operators="ML-2",
    sql="""SELECT app_id, CAST((row_number() OVER (ORDER BY md5(CAST(app_id AS VARCHAR) || '|42'), app_id) - 1) % 5
 AS INTEGER) AS fold FROM scored"""))


def _cv_frozen(spark, sf):
    fm = T.fold_metrics(_folds(spark, sf), "fold", "defaulted", "risk_score")
    return T.aggregate_cv(fm)


_FOLD = "CAST((row_number() OVER (PARTITION BY LoanApproved ORDER BY md5(CAST(app_id AS VARCHAR) || '|42'), app_id) - 1) % 5 AS INTEGER)"
register(Query(
    "cv_summary_frozen", _cv_frozen, operators="ML-9", floats=["mean", "std", "min", "max"],
    ctes=f"""fd AS (SELECT *, {_FOLD} AS fold FROM scored),
rk AS (SELECT fold, defaulted, (rank() OVER (PARTITION BY fold ORDER BY risk_score) + rank() OVER (PARTITION BY fold ORDER BY risk_score)
  + count(*) OVER (PARTITION BY fold, risk_score) - 1) / 2.0 AS r FROM fd),
auc AS (SELECT fold, (sum(CASE WHEN defaulted = 1 THEN r ELSE 0 END) - count_if(defaulted = 1) * (count_if(defaulted = 1) + 1) / 2.0)
  / (CAST(count_if(defaulted = 1) AS DOUBLE) * count_if(defaulted = 0)) AS roc_auc FROM rk GROUP BY fold),
sc AS (SELECT fold, risk_score, count_if(defaulted = 1) AS p, count(*) AS n FROM fd GROUP BY fold, risk_score),
cu AS (SELECT fold, p, sum(p) OVER w AS tp, sum(n) OVER w AS al, sum(p) OVER (PARTITION BY fold) AS pt, n FROM sc
  WINDOW w AS (PARTITION BY fold ORDER BY risk_score DESC)),
pr AS (SELECT fold, sum(CAST(p AS DOUBLE) / pt * (CAST(tp AS DOUBLE) / al
  + CASE WHEN al = n THEN 1.0 ELSE CAST(tp - p AS DOUBLE) / (al - n) END) / 2.0) AS pr_auc FROM cu GROUP BY fold),
cm AS (SELECT fold, count_if(risk_score >= 0.5 AND defaulted = 1) AS tp, count_if(risk_score < 0.5 AND defaulted = 0) AS tn,
  count_if(risk_score >= 0.5 AND defaulted = 0) AS fp, count_if(risk_score < 0.5 AND defaulted = 1) AS fn,
  -avg(CASE WHEN defaulted = 1 THEN ln(greatest(risk_score, 2.220446049250313e-16))
            ELSE ln(1 - least(risk_score, 1 - 2.220446049250313e-16)) END) AS log_loss FROM fd GROUP BY fold),
fm AS (SELECT fold, 'roc_auc' AS metric, roc_auc AS value FROM auc
  UNION ALL SELECT fold, 'pr_auc', pr_auc FROM pr
  UNION ALL SELECT fold, 'log_loss', log_loss FROM cm
  UNION ALL SELECT fold, 'accuracy', (tp + tn) / (tp + tn + fp + fn) FROM cm
  UNION ALL SELECT fold, 'precision', CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END FROM cm
  UNION ALL SELECT fold, 'recall', CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END FROM cm
  UNION ALL SELECT fold, 'f1', CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END FROM cm
  UNION ALL SELECT fold, 'specificity', CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END FROM cm
  UNION ALL SELECT fold, 'npv', CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn) END FROM cm
  UNION ALL SELECT fold, 'mcc', CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0
    ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
      / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) END FROM cm
  UNION ALL SELECT fold, 'tp', tp FROM cm UNION ALL SELECT fold, 'tn', tn FROM cm
  UNION ALL SELECT fold, 'fp', fp FROM cm UNION ALL SELECT fold, 'fn', fn FROM cm)""",
    sql="SELECT metric, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max FROM fm GROUP BY metric"))


def _training_tables(spark, sf):
    """IO-3: the training summary tables as files, counted after reading them
    back: one row per (table, rows)."""
    sp = S.stratified_split(X.scored(spark, sf), TARGET, "app_id")
    sp = cut_lineage(S.stratified_folds(sp, TARGET, "app_id"))
    t = T.train_all(sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test"), ["logistic_regression"],
                    NUMERIC, CATEGORICAL)
    path = R.scratch(spark, "training")
    R.write_training(t, path)
    read = {"cv_results": 14 * 2, "cv_folds": 14 * 2 * 5, "evaluation": 1}
    out = [spark.read.csv(f"{path}/{n}.csv", header=True).agg(F.count(F.lit(1)).alias("rows"))
           .select(F.lit(n).alias("name"), "rows") for n in read]
    top = spark.read.csv(f"{path}/importance.csv", header=True) \
        .agg((F.count(F.lit(1)) - F.count("importance")).alias("rows")).select(F.lit("importance_nulls").alias("name"), "rows")
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(top)


register(Query("training_tables", _training_tables, operators="IO-3 ML-7"))

MODELS = ["logistic_regression", "gbt", "gbt_deep"]


def _selection(spark, sf):
    sp = S.stratified_split(X.scored(spark, sf), TARGET, "app_id")
    sp = cut_lineage(S.stratified_folds(sp, TARGET, "app_id"))
    t = T.train_all(sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test"), MODELS, NUMERIC, CATEGORICAL)
    return t.summary


register(Query("model_selection", _selection, operators="ML-8 ML-9 ML-10"))


def _importance(spark, sf):
    m, _ = _fit(spark, sf, "logistic_regression")
    return T.feature_importance(m)


register(Query("feature_importance", _importance, operators="ML-11"))


def _selection_fe(spark, sf):
    imp = _importance(spark, sf)
    return FE.select_features(imp)


register(Query("feature_selection", _selection_fe, operators="FE-17"))


def _corr_drop(spark, sf):
    a = X.applications(spark, sf)
    cols = NUMERIC + ["risk_score"]
    kept = FE.drop_correlated(P.correlation_long(a, cols), cols, 0.95)
    return literal_table(spark, [(c, c in kept) for c in cols], "feature string, kept boolean")


def _corr_filter_sql(cols: list[str], th: float = 0.95) -> str:
    """The greedy filter unrolled: column j is kept iff every earlier kept
    column has |corr| <= th with it."""
    corr = ", ".join(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS c_{i}_{j}"
                     for j, b in enumerate(cols) for i, a in enumerate(cols) if i < j)
    kept = []
    for j in range(len(cols)):
        conds = [f"(NOT k{i} OR abs(c_{i}_{j}) <= {th})" for i in range(j)]
        kept.append(f"{' AND '.join(conds) if conds else 'true'} AS k{j}")
    # each k_j refers to earlier k_i: build them in nested selects
    sql = f"SELECT {corr} FROM applications"
    for j, k in enumerate(kept):
        sql = f"SELECT *, {k} FROM ({sql}) s{j}"
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, k{j} AS kept FROM ({sql}) t{j}" for j, c in enumerate(cols))


register(Query("correlation_filter", _corr_drop, operators="FE-17",
               sql=_corr_filter_sql(NUMERIC + ["risk_score"])))


def _early(spark, sf):
    sp = cut_lineage(S.stratified_split(X.scored(spark, sf), TARGET, "app_id", S.SPLIT_701515))
    part = lambda name: sp.where(F.col("split") == name)
    m = T.fit_model(part("train"), "gbt", NUMERIC, CATEGORICAL, params={"validation_tol": 0.01}, validation=part("val"))
    te = m.score(part("test")).select("defaulted", "probability_default")
    auc = V.ranking_metrics(te, "defaulted", "probability_default").first()["roc_auc"]
    n = m.model.getNumTrees
    return literal_table(spark, [(1 <= n <= 100, bool(auc > 0.8), float(m.model.getOrDefault("validationTol")))],
                         "stopped_in_range boolean, test_auc_above_080 boolean, validation_tol double")


register(Query("gbt_early_stopping", _early, operators="ML-14", floats=["validation_tol"]))


def _random_search(spark, sf):
    r = T.random_search(_folds(spark, sf), "logistic_regression", NUMERIC, CATEGORICAL, n_trials=2)
    return r.select("trial", "state", "folds", "mean_roc_auc")


register(Query("random_search", _random_search, operators="ML-12"))


def _batch_predict(spark, sf):
    m, sp = _fit(spark, sf, "logistic_regression")
    return SC.batch_predict(m, sp).select("app_id", "prediction", "probability", "risk_level")


register(Query("batch_predict", _batch_predict, operators="SC-1 IO-2"))


def _top_attached(spark, sf):
    """The score's own linear model is the frozen one, so SQL can follow."""
    rows = [(f, abs(w), w) for f, w in SC.FROZEN_LINEAR.items()]
    top = T.top_features(literal_table(spark, rows, "feature string, importance double, value double"), 2)
    return SC.attach_top_features(X.scored(spark, sf).select("app_id", "risk_score"), top, 2) \
        .select("app_id", "risk_score", F.array_join(F.transform("top_features", lambda t: F.concat(
            t["feature"], F.lit("="), F.round(t["coefficient"], 6).cast("string"))), ";").alias("top"))


register(Query("top_features_attached", _top_attached, operators="SC-5", floats=["risk_score"],
               sql="SELECT app_id, risk_score, 'debt_to_income=0.1;CreditScore=-0.0125' AS top FROM scored"))
