"""ML-4..14: model training and selection on Spark ML.

The label is ``defaulted`` (1 = default), so every predicted probability is
P(default) -- the polarity the decision policy expects. Preparation is fitted
inside each fold (no leakage from the held-out fold)."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import literal_table
from ..session import cut_lineage
from . import folds as FO
from . import search as SE
from .boosting import TREE_PRESETS, Booster, TreeParams, fit_boosted, score_boosted
from .evaluation import EPS, auc_by, confusion_aggs, evaluation_report, metrics_from_confusion
from .features import Preprocessor, SparsePreprocessor, fit_preprocessor
from .gradient_trees import MAX_DEPTH, GradientTrees, fit_gradient_trees, score_gradient_trees
from .ordered import same, value_cumsums
from .sampling import class_weights

# Model presets (fixed values): logistic regression C = 1, L2, 1000 iterations;
# boosted trees depth 6 / lr 0.1 / 100 rounds / subsample 0.8 / colsample 0.8;
# second boosted preset depth 7. The kinds of ``boosting.TREE_PRESETS`` have
# L1 / L2 and, in the second preset, at most 31 leaves as well.
PRESETS = {
    "logistic_regression": {"C": 1.0, "max_iter": 1000, "tol": 1e-9},
    "gbt": {"max_depth": 6, "learning_rate": 0.1, "n_estimators": 100, "subsample": 0.8, "colsample": 0.8},
    "gbt_deep": {"max_depth": 7, "learning_rate": 0.1, "n_estimators": 100, "subsample": 0.8, "colsample": 0.8},
}
SEED = 42


def make_estimator(kind: str, n_train: int, params: dict | None = None, weight_col: str | None = None,
                   label: str = "defaulted", features: str = "features"):
    """Model lookup by name (unknown name -> ValueError).

    Logistic regression: scikit-learn minimises 1/2||w||^2 + C * sum(s_i l_i);
    Spark minimises sum(s_i l_i) / sum(s_i) + lambda/2 ||w||^2, so
    lambda = 1 / (C * sum(s_i)) (= 1 / (C n) with balanced weights). The
    intercept is unpenalised in both; features are already standardised.
    ``tol`` 1e-9 reproduces the scikit-learn optimum; every iteration is one
    pass over the (cached) training vectors, so on very large inputs pass a
    looser ``tol`` in ``params``."""
    p = {**PRESETS.get(kind, {}), **(params or {})}
    if kind == "logistic_regression":
        est = LogisticRegression(featuresCol=features, labelCol=label, maxIter=int(p["max_iter"]),
                                 regParam=1.0 / (p["C"] * max(n_train, 1)), elasticNetParam=0.0,
                                 standardization=False, tol=float(p["tol"]), family="binomial")
    elif kind in ("gbt", "gbt_deep"):
        kw = {}
        if p.get("validation_col"):  # ML-14: early stopping on a validation subset
            kw = {"validationIndicatorCol": p["validation_col"], "validationTol": float(p.get("validation_tol", 0.01))}
        est = GBTClassifier(featuresCol=features, labelCol=label, maxDepth=int(p["max_depth"]),
                            stepSize=float(p["learning_rate"]), maxIter=int(p["n_estimators"]),
                            subsamplingRate=float(p["subsample"]),
                            featureSubsetStrategy=str(p["colsample"]), seed=SEED, **kw)
    else:
        raise ValueError(f"unknown model {kind!r}")
    if weight_col:
        est = est.setWeightCol(weight_col)
    return est


@dataclass
class Fitted:
    kind: str
    prep: Preprocessor | SparsePreprocessor
    model: object

    def score(self, df: DataFrame, out: str = "probability_default") -> DataFrame:
        """SC-1: probability of default, predicted class at 0.5."""
        if isinstance(self.model, Booster):
            x = score_gradient_trees(df, self.prep, self.model, out) if isinstance(self.model, GradientTrees) \
                else score_boosted(self.prep.transform(df), self.model, out)
            return x.select(*df.columns, out, (F.col(out) >= 0.5).cast("int").alias("prediction"))
        p = self.model.transform(self.prep.vector(df))
        prob = vector_to_array(F.col("probability"))[1]
        keep = [c for c in df.columns]
        return p.select(*[F.col(c) for c in keep], prob.alias(out),
                        (prob >= 0.5).cast("int").alias("prediction"))


def fit_model(train: DataFrame, kind: str, numeric: list[str], categorical: list[str],
              label: str = "defaulted", balanced: bool = True, params: dict | None = None,
              validation: DataFrame | None = None) -> Fitted:
    """ML-7: fit preparation and model on the training rows only. ``balanced``:
    both classes weigh the same in total in the linear model; the boosted
    models weigh positives by n_neg / n_pos (their usual form). ``validation``
    (ML-14): rows that only decide when boosting stops; nothing is prepared
    from them."""
    prep = fit_preprocessor(train, numeric, categorical)
    x = train
    wcol = None
    if balanced:
        x = class_weights(x, label, positive_only=kind != "logistic_regression", out="__w")
        wcol = "__w"
    params = dict(params or {})
    if kind in TREE_PRESETS:
        if isinstance(prep, SparsePreprocessor):
            raise ValueError(f"{sum(prep.sizes.values())} levels are too many for trees: encode them by target or frequency first")
        patience = params.pop("patience", 10)
        held = prep.transform(validation) if validation is not None else None
        model = fit_boosted(prep.transform(x), prep.feature_cols, label, train.columns, replace(TREE_PRESETS[kind], **params),
                            weight=wcol, validation=held, patience=patience)
        return Fitted(kind, prep, model)
    if kind in GRADIENT_KINDS and validation is None and _together(prep, kind, params):
        return Fitted(kind, prep, fit_gradient_trees([(x, prep)], label, wcol, _gradient_params(kind, params))[0])
    if validation is not None:
        stop = "__validation"
        x = x.withColumn(stop, F.lit(False)).unionByName(
            validation.withColumn(stop, F.lit(True)).withColumn("__w", F.lit(1.0)) if balanced
            else validation.withColumn(stop, F.lit(True)))
        params["validation_col"] = stop
    x = prep.vector(x)
    n = train.count() if kind == "logistic_regression" else 1      # only its penalty depends on n
    est = make_estimator(kind, n, params, wcol, label)
    return Fitted(kind, prep, est.fit(x))


#: Kinds grown by ``gradient_trees``. Spark's own trees serve them with a
#: validation subset, levels in a table, or deeper trees.
GRADIENT_KINDS = ("gbt", "gbt_deep")


def _together(prep, kind: str, params: dict | None) -> bool:
    return isinstance(prep, Preprocessor) and int({**PRESETS[kind], **(params or {})}["max_depth"]) <= MAX_DEPTH


def _gradient_params(kind: str, params: dict | None) -> TreeParams:
    p = {**PRESETS[kind], **(params or {})}
    depth = int(p["max_depth"])
    return TreeParams(n_estimators=int(p["n_estimators"]), learning_rate=float(p["learning_rate"]), max_leaves=1 << depth, max_depth=depth,
                      subsample=float(p["subsample"]), colsample=float(p["colsample"]), l2=0.0, min_rows=1, min_hessian=0.0, max_bins=32, seed=SEED)


#: Metrics of a fold, in this order (fixed names).
FOLD_METRICS = ["roc_auc", "pr_auc", "log_loss", "accuracy", "precision", "recall", "f1", "mcc", "specificity", "npv",
                "tp", "tn", "fp", "fn"]


def fold_metrics(scored: DataFrame, fold_col: str, y: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Per fold all of ``FOLD_METRICS`` (exact ranking metrics, ties half; log
    loss; rates and counts at the threshold), for all folds from two passes:
    one table of distinct scores by fold, one aggregate."""
    d = scored.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    yy = F.col(y).cast("long")
    c = value_cumsums(d, [score], {"pos": yy, "neg": F.lit(1) - yy}, by=[fold_col])
    tp, fp = F.col("pos_tot") - F.col("pos_lt"), F.col("neg_tot") - F.col("neg_lt")
    tp_above, above = F.col("pos_tot") - F.col("pos_le"), (F.col("pos_tot") - F.col("pos_le")) + (F.col("neg_tot") - F.col("neg_le"))
    step = F.try_divide(tp - tp_above, F.col("pos_tot").cast("double"))
    before = F.when(above == 0, F.lit(1.0)).otherwise(F.try_divide(tp_above, above))
    rank = c.groupBy(fold_col).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("neg_lt") + F.col("neg") / 2.0)),
                     F.first("pos_tot") * F.first("neg_tot").cast("double")).alias("roc_auc"),
        F.sum(step * (F.try_divide(tp, tp + fp) + before) / 2.0).alias("pr_auc"))
    p = F.least(F.greatest(F.col(score), F.lit(EPS)), F.lit(1 - EPS))
    counts = d.groupBy(fold_col).agg(
        *confusion_aggs(y, score, threshold),
        (-F.avg(yy * F.log(p) + (1 - yy) * F.log(1 - p))).alias("log_loss"))
    wide = same(metrics_from_confusion(counts), rank, [fold_col])
    return wide.select(fold_col, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in FOLD_METRICS])).alias("kv")) \
        .select(fold_col, "kv.*")


def aggregate_cv(fold_scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ML-9: mean, std (ddof 0), min, max of each metric over folds."""
    keys = keys or []
    return fold_scores.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def cross_validate(df: DataFrame, kind: str, numeric: list[str], categorical: list[str], fold_col: str = "fold",
                   label: str = "defaulted", k: int = 5, params: dict | None = None,
                   parallelism: int | None = None) -> tuple[DataFrame, DataFrame]:
    """ML-8: for each fold, fit preparation + model on the other folds, score
    the held-out fold (test) and the training folds (train). Returns
    (out-of-fold predictions, per-fold metrics with ``split`` train/test).
    Folds are fitted from driver threads in parallel (one thread per fold by
    default); every fit is a set of distributed Spark jobs. Logistic folds are
    fitted together instead: passes over the data serve all of them (unless
    there are too many features for that); so are folds of ``GRADIENT_KINDS``. Pass fold-tagged rows that were
    checkpointed or read from a table: the fits re-read them. Predictions are
    checkpointed, so no metric scores a fold again."""
    if kind == "logistic_regression" and set(params or {}) <= {"C"}:
        try:
            return _cross_validate_together(df, numeric, categorical, fold_col, label, k, (params or {}).get("C", 1.0))
        except FO.TooWide:
            pass

    def parts(i):
        return df.where(F.col(fold_col) != i), df.where(F.col(fold_col) == i)

    def scores(i, m):
        tr, te = parts(i)
        return m.score(te), m.score(tr).withColumn(fold_col, F.lit(i))

    def one(i):
        return scores(i, fit_model(parts(i)[0], kind, numeric, categorical, label, params=params))
    with ThreadPoolExecutor(max_workers=max(1, parallelism or k)) as ex:
        together = None
        if kind in GRADIENT_KINDS:
            preps = list(ex.map(lambda i: fit_preprocessor(parts(i)[0], numeric, categorical), range(k)))
            if all(_together(p, kind, params) for p in preps):
                weighed = ex.map(lambda i: class_weights(parts(i)[0], label, positive_only=True, out="__w"), range(k))
                together = fit_gradient_trees(list(zip(weighed, preps)), label, "__w", _gradient_params(kind, params))
        res = [scores(i, Fitted(kind, p, m)) for i, (p, m) in enumerate(zip(preps, together))] if together else list(ex.map(one, range(k)))
    oof = res[0][0]
    for r in res[1:]:
        oof = oof.unionByName(r[0])
    oof = cut_lineage(oof)
    test_m = fold_metrics(oof, fold_col, label, "probability_default").withColumn("split", F.lit("test"))
    tr_all = res[0][1]
    for r in res[1:]:
        tr_all = tr_all.unionByName(r[1])
    tr_all = cut_lineage(tr_all.select(fold_col, label, "probability_default"))
    train_m = fold_metrics(tr_all, fold_col, label, "probability_default").withColumn("split", F.lit("train"))
    return oof, test_m.unionByName(train_m)


def _cross_validate_together(df, numeric, categorical, fold_col, label, k, c):
    known = df.where(F.col(fold_col).isNotNull())
    fitted = FO.fit_together(known, [FO.Spec(i, c) for i in range(k)], numeric, categorical, label, fold_col, k)
    p = cut_lineage(FO.probabilities(known, fitted, label, fold_col, "__p"))
    prob = F.try_element_at("__p", F.col(fold_col) + 1)
    oof = p.where(F.col(fold_col).between(0, k - 1)).select(
        *df.columns, prob.alias("probability_default"), (prob >= 0.5).cast("int").alias("prediction"))
    mine = p.select(F.col(fold_col).alias("__own"), label, F.posexplode("__p").alias("__fold", "probability_default")) \
        .where(F.col("__own") != F.col("__fold")).select(F.col("__fold").alias(fold_col), label, "probability_default")
    parts = [fold_metrics(x, fold_col, label, "probability_default").withColumn("split", F.lit(name))
             for x, name in ((oof, "test"), (mine, "train"))]
    return oof, parts[0].unionByName(parts[1])


def select_best(cv_summary: DataFrame, order: list[str]) -> str | None:
    """ML-10: model with the highest mean test ROC-AUC; ties (strictly
    greater wins) go to the earlier model in ``order``."""
    pos = {m: i for i, m in enumerate(order)}
    rows = cv_summary.where((F.col("metric") == "roc_auc") & (F.col("split") == "test")).collect()
    best, best_v = None, None
    for r in sorted(rows, key=lambda r: pos.get(r["model"], 1 << 30)):
        if best_v is None or (r["mean"] is not None and r["mean"] > best_v):
            best, best_v = r["model"], r["mean"]
    return best


@dataclass
class Trained:
    """Result of ``train_all``: the refitted best model, the CV summary of all
    models, per-fold metrics, out-of-fold predictions of all models, and the
    test evaluation of the refitted model."""
    best: str
    model: Fitted
    summary: DataFrame
    folds: DataFrame
    oof: DataFrame
    evaluation: DataFrame


def train_all(folds: DataFrame, test: DataFrame, kinds: list[str], numeric: list[str], categorical: list[str],
              fold_col: str = "fold", label: str = "defaulted", k: int = 5, params: dict | None = None) -> Trained:
    """ML-7..10: cross-validate every model on the fold-tagged training rows,
    select by mean test ROC-AUC, refit the best on all of them and evaluate it
    on ``test``. ``params``: per kind. One checkpoint of the rows serves all."""
    folds = cut_lineage(folds)

    def one(kind):
        oof, fm = cross_validate(folds, kind, numeric, categorical, fold_col, label, k, (params or {}).get(kind))
        return oof.withColumn("model", F.lit(kind)), fm.withColumn("model", F.lit(kind))
    with ThreadPoolExecutor(max_workers=len(kinds)) as ex:
        res = list(ex.map(one, kinds))
    oof, fm = res[0]
    for o, m in res[1:]:
        oof, fm = oof.unionByName(o), fm.unionByName(m)
    fm = cut_lineage(fm)                       # models x folds x metrics rows
    summary = aggregate_cv(fm, ["model", "split"])
    best = select_best(summary, kinds)
    model = fit_model(folds, best, numeric, categorical, label, params=(params or {}).get(best))
    scored = cut_lineage(model.score(test))
    ev = evaluation_report(scored, label, "probability_default").withColumn("model", F.lit(best))
    return Trained(best, model, summary.withColumn("selected", F.col("model") == F.lit(best)), fm, oof, ev)


def feature_importance(fitted: Fitted) -> DataFrame:
    """ML-11: |coefficient| for linear models, split-gain importance for trees
    (dispatch on the fitted class), descending."""
    m = fitted.model
    if isinstance(fitted.prep, SparsePreprocessor):       # names stay in their table
        signed = (m.coefficients if hasattr(m, "coefficients") else m.featureImportances).toArray()
        values = fitted.prep.index.sparkSession.createDataFrame(list(enumerate(signed.tolist())), "position int, value double")
        return fitted.prep.names().join(values, "position").select("feature", F.abs("value").alias("importance"), "value") \
            .orderBy(F.col("importance").desc(), "feature")
    names = fitted.prep.feature_names
    if isinstance(m, Booster):
        vals = signed = [v for _, v in m.importance()]
    elif hasattr(m, "coefficients"):
        vals = [abs(float(v)) for v in m.coefficients.toArray()]
        signed = [float(v) for v in m.coefficients.toArray()]
    else:
        vals = [float(v) for v in m.featureImportances.toArray()]
        signed = vals
    spark = SparkSession.getActiveSession()
    rows = [(n, v, s) for n, v, s in zip(names, vals, signed)]
    return literal_table(spark, rows, "feature string, importance double, value double") \
        .orderBy(F.col("importance").desc(), "feature")


def hyper_search(df: DataFrame, kind: str, numeric: list[str], categorical: list[str], n_trials: int = 100,
                 fold_col: str = "fold", k: int = 5, seed: int = SEED, label: str = "defaulted", parallel: int = 4,
                 sampler: str = "tpe", prune: bool = True, space: dict | None = None) -> DataFrame:
    """ML-12: search over the documented ranges; one row per trial: ``trial,
    params, state`` (complete or pruned), ``folds`` (scored), ``fold_roc_auc``
    and ``mean_roc_auc``.

    ``space``: parameters and ranges (default: ``search.SPACES``). ``sampler``: ``tpe`` (density ratio over earlier trials) or ``random``;
    ``prune``: stop a trial whose mean falls below the median of earlier trials
    at the same fold. Trials of a round run side by side: logistic ones share
    their passes over the data. Preparation is fitted inside the folds. Pass
    fold-tagged, written rows. The same seed gives the same trials."""
    if sampler not in ("tpe", "random"):
        raise ValueError(f"unknown sampler {sampler!r}")
    known = df.where(F.col(fold_col).isNotNull())
    if kind == "logistic_regression":
        score = _logistic_scores(known, numeric, categorical, fold_col, k, label)
    else:
        def score(params, fold):
            def one(p):
                m = fit_model(known.where(F.col(fold_col) != fold), kind, numeric, categorical, label, params=p)
                s = m.score(known.where(F.col(fold_col) == fold)).select(F.lit(0).alias("trial"), label, "probability_default")
                return auc_by(s, "trial", label, "probability_default").get(0) or 0.5
            with ThreadPoolExecutor(max_workers=len(params)) as ex:
                return list(ex.map(one, params))
    trials = SE.search(space or SE.SPACES[kind], score, k, n_trials, parallel, seed,
                       startup=SE.STARTUP if sampler == "tpe" else n_trials, warmup=SE.WARMUP if prune else n_trials)
    rows = [(t.number, str(t.params), "pruned" if t.pruned else "complete", len(t.scores), ",".join(map(repr, t.scores)), t.mean)
            for t in trials]
    out = literal_table(df.sparkSession, rows, "trial int, params string, state string, folds int, fold_roc_auc string, mean_roc_auc double")
    return out.withColumn("fold_roc_auc", F.split("fold_roc_auc", ",").cast("array<double>"))


def _logistic_scores(df, numeric, categorical, fold_col, k, label):
    """Scores of some penalties on a fold, all fitted and scored together."""
    prep = FO.prepare(df, numeric, categorical, label, fold_col, k, [FO.Spec(i) for i in range(k)])
    table = cut_lineage(df.select(*FO.coded(df, prep, label, fold_col)))
    known: dict[int, list] = {}                # per fold: (log C, coefficients) of earlier trials

    def score(params, fold):
        before = known.setdefault(fold, [])
        start = np.stack([min(before, key=lambda b: abs(b[0] - math.log(p["C"])))[1] for p in params]) if before else None
        fitted = FO.newton(table, prep.pick([fold] * len(params)), [FO.Spec(fold, p["C"]) for p in params], start=start)
        before += [(math.log(p["C"]), b) for p, b in zip(params, fitted.beta)]
        held = FO.probabilities(df.where(F.col(fold_col) == fold), fitted, label, fold_col, "__p")
        long = held.select(label, F.posexplode("__p").alias("trial", "p"))
        got = auc_by(long, "trial", label, "p")
        return [0.5 if got.get(i) is None else got[i] for i in range(len(params))]
    return score


def random_search(df: DataFrame, kind: str, numeric: list[str], categorical: list[str], n_trials: int = 100,
                  fold_col: str = "fold", k: int = 5, seed: int = SEED, label: str = "defaulted") -> DataFrame:
    """ML-12 without a model of earlier trials: random parameters, every fold
    of every trial scored."""
    return hyper_search(df, kind, numeric, categorical, n_trials, fold_col, k, seed, label, sampler="random", prune=False)


def top_features(importance: DataFrame, n: int = 5) -> DataFrame:
    """SC-5 helper: the n most important features (global), ties by name."""
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))  # k rows, one per feature
    return importance.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
