"""Fitted models with SQL: logistic regressions by Newton's method written out
(ML-4, ML-7, ML-8, ML-10, ML-11, ML-12, EV-14, FE-17, SC-1), the splits of
leaf-wise trees (ML-5, ML-6), early stopping (ML-14) and nearest-neighbour
oversampling (ML-13). The logistic models use two numeric columns, because SQL
solves their normal equations by Cramer's rule; the library code is the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.columns import literal_table
from ..operators import boosting as B
from ..operators import evaluation as V
from ..operators import features as FE
from ..operators import oversampling as O
from ..operators import sampling as S
from ..operators import scoring as SC
from ..operators import search as SE
from ..operators import training as T
from ..session import cut_lineage
from ..sources import fixtures as X
from ..sources.fixtures import NUMERIC, TARGET
from . import reports as R
from .catalog import Query, register
from .feature_queries import _split_sql
from .sql_fits import newton_sql

TWO = ["CreditScore", "Income"]
_FOLD = "CAST((row_number() OVER (PARTITION BY LoanApproved ORDER BY md5(CAST(app_id AS VARCHAR) || '|42'), app_id) - 1) % 5 AS INTEGER)"
_SPLIT = f"sp AS ({_split_sql('scored', [('train', 8000), ('test', 10000)])})"


def _scaled_sql(src: str, where: str, groups: str = "0", ridge: str = "1e0") -> tuple[str, str]:
    """Statistics of the training rows per g, and their scaled, weighted rows."""
    stats = f"""(SELECT g, avg(CreditScore) AS m1, stddev_pop(CreditScore) AS s1, avg(Income) AS m2, stddev_pop(Income) AS s2,
  count(*) AS n, sum(defaulted) AS pos, any_value(ridge) AS ridge FROM (SELECT *, {groups} AS g, {ridge} AS ridge FROM {src} WHERE {where}) GROUP BY g)"""
    rows = f"""(SELECT t.g, (CreditScore - m1) / s1 AS z1, (Income - m2) / s2 AS z2, CAST(defaulted AS DOUBLE) AS y,
  CASE WHEN defaulted = 1 THEN n / (2e0 * pos) ELSE n / (2e0 * (n - pos)) END AS w, t.ridge AS r1, t.ridge AS r2
  FROM (SELECT *, {groups} AS g, {ridge} AS ridge FROM {src} WHERE {where}) t JOIN st ON t.g = st.g)"""
    return stats, rows


# -- ML-4, ML-7, ML-11, FE-17, SC-1 ----------------------------------------------------

def _two_split(spark, sf):
    return cut_lineage(S.stratified_split(X.scored(spark, sf), TARGET, "app_id"))


def _two_fit(sp):
    return T.fit_model(sp.where(F.col("split") == "train"), "logistic_regression", TWO, [], params={"tol": 1e-14})


_STATS, _ROWS = _scaled_sql("sp", "split = 'train'")
_FIT = f"{_SPLIT},\nst AS MATERIALIZED {_STATS},\nlr AS MATERIALIZED {_ROWS},\n" + newton_sql("lr", "fit")
_PROB = "1 / (1 + exp(-(a + b1 * (CreditScore - m1) / s1 + b2 * (Income - m2) / s2)))"


def _importance(spark, sf):
    m = _two_fit(_two_split(spark, sf))
    both = FE.select_features(T.feature_importance(m))
    start = literal_table(spark, [("intercept", None, float(m.model.intercept), None)], "feature string, importance double, value double, rank int")
    return both.select("feature", "importance", "value", "rank").unionByName(start)


register(Query(
    "logistic_coefficients", _importance, operators="ML-4 ML-11 FE-17", floats=["importance", "value"], ctes=_FIT,
    sql="""SELECT feature, abs(value) AS importance, value, CAST(row_number() OVER (ORDER BY abs(value) DESC) AS INTEGER) AS rank
FROM (SELECT 'CreditScore' AS feature, b1 AS value FROM fit UNION ALL SELECT 'Income', b2 FROM fit)
UNION ALL SELECT 'intercept', NULL, a, NULL FROM fit"""))


def _predict(spark, sf):
    sp = _two_split(spark, sf)
    return SC.batch_predict(_two_fit(sp), sp).select("app_id", "prediction", "probability", "risk_level")


register(Query(
    "batch_predict_two", _predict, operators="SC-1 ML-7", floats=["probability"], digits={"probability": 4}, ctes=_FIT,
    sql=f"""SELECT app_id, CAST(p >= 5e-1 AS INTEGER) AS prediction, p AS probability,
  CASE WHEN p <= 0 THEN NULL WHEN p <= 3e-1 THEN 'Low Risk' WHEN p <= 7e-1 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_level
FROM (SELECT app_id, {_PROB} AS p FROM sp, fit, st)"""))


def _holdout_two(spark, sf):
    sp = _two_split(spark, sf)
    te = cut_lineage(_two_fit(sp).score(sp.where(F.col("split") == "test")).select("defaulted", "probability_default"))
    return V.evaluation_report(te, "defaulted", "probability_default").select("roc_auc", "log_loss", "accuracy", "tp", "tn", "fp", "fn")


_AUC_OF = """(sum(CASE WHEN defaulted = 1 THEN r ELSE 0 END) - count_if(defaulted = 1) * (count_if(defaulted = 1) + 1) / 2.0)
 / (CAST(count_if(defaulted = 1) AS DOUBLE) * count_if(defaulted = 0))"""


def _rank_sql(score: str, over: str = "") -> str:
    part = f"PARTITION BY {over} " if over else ""
    same = f"PARTITION BY {over + ', ' if over else ''}{score}"
    return f"(rank() OVER ({part}ORDER BY {score}) + count(*) OVER ({same}) / 2.0 - 0.5)"


register(Query(
    "logistic_holdout_two", _holdout_two, operators="ML-4 ML-7 EV-15", floats=["roc_auc", "log_loss", "accuracy"],
    ctes=_FIT + f",\nte AS MATERIALIZED (SELECT defaulted, {_PROB} AS p FROM sp, fit, st WHERE split = 'test')",
    sql=f"""SELECT (SELECT {_AUC_OF} FROM (SELECT defaulted, {_rank_sql('p')} AS r FROM te)) AS roc_auc,
 -avg(CASE WHEN defaulted = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss,
 avg(CAST((p >= 5e-1) = (defaulted = 1) AS DOUBLE)) AS accuracy, count_if(p >= 5e-1 AND defaulted = 1) AS tp,
 count_if(p < 5e-1 AND defaulted = 0) AS tn, count_if(p >= 5e-1 AND defaulted = 0) AS fp, count_if(p < 5e-1 AND defaulted = 1) AS fn FROM te"""))

# -- ML-8 ------------------------------------------------------------------------------

_CV_STATS, _CV_ROWS = _scaled_sql("fm", "fold <> out_fold", "out_fold")
_CV = f"""fd AS MATERIALIZED (SELECT *, {_FOLD} AS fold FROM scored),
fm AS MATERIALIZED (SELECT fd.*, CAST(i AS INTEGER) AS out_fold FROM fd, range(5) t(i)),
st AS MATERIALIZED {_CV_STATS},
lr AS MATERIALIZED {_CV_ROWS},
""" + newton_sql("lr", "fit")


def _cv_two(spark, sf):
    return T.cross_validate(cut_lineage(S.stratified_folds(X.scored(spark, sf), TARGET, "app_id")), "logistic_regression", TWO, [])


def _oof_two(spark, sf):
    return _cv_two(spark, sf)[0].select("app_id", "fold", "defaulted", "probability_default", "prediction")


register(Query(
    "oof_predictions_two", _oof_two, operators="ML-8", floats=["probability_default"], ctes=_CV,
    sql=f"""SELECT app_id, fold, defaulted, p AS probability_default, CAST(p >= 5e-1 AS INTEGER) AS prediction
FROM (SELECT app_id, fold, defaulted, {_PROB} AS p FROM fd JOIN fit ON fit.g = fold JOIN st ON st.g = fold)"""))


def _cv_metrics_two(spark, sf):
    return _cv_two(spark, sf)[1].where(F.col("metric").isin("roc_auc", "log_loss", "tp", "fp"))


register(Query(
    "cross_validate_two", _cv_metrics_two, operators="ML-8", floats=["value"],
    ctes=_CV + f""",
pm AS MATERIALIZED (SELECT out_fold AS fold, defaulted, {_PROB} AS p, CASE WHEN fold = out_fold THEN 'test' ELSE 'train' END AS split
  FROM fm JOIN fit ON fit.g = out_fold JOIN st ON st.g = out_fold),
pr AS MATERIALIZED (SELECT *, {_rank_sql('p', 'fold, split')} AS r FROM pm),
ms AS (SELECT fold, split, {_AUC_OF} AS roc_auc, -avg(CASE WHEN defaulted = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss,
  CAST(count_if(p >= 5e-1 AND defaulted = 1) AS DOUBLE) AS tp, CAST(count_if(p >= 5e-1 AND defaulted = 0) AS DOUBLE) AS fp FROM pr GROUP BY fold, split)""",
    sql="SELECT fold, metric, value, split FROM ms UNPIVOT (value FOR metric IN (roc_auc, log_loss, tp, fp))"))

# -- IO-3 ------------------------------------------------------------------------------

def _tables_two(spark, sf):
    """The training summary as CSV files, read back: cross-validation results,
    test evaluation and importance of the refitted model."""
    sp = S.stratified_split(X.scored(spark, sf), TARGET, "app_id")
    sp = cut_lineage(S.stratified_folds(sp, TARGET, "app_id"))
    t = T.train_all(sp.where("split = 'train'"), sp.where("split = 'test'"), ["logistic_regression"], TWO, [],
                    params={"logistic_regression": {"C": 1.0}})
    path = R.scratch(spark, "training-two")
    R.write_training(t, path)
    read = lambda n: spark.read.csv(f"{path}/{n}.csv", header=True)
    cv = read("cv_results").where("metric IN ('roc_auc', 'log_loss')")
    number = lambda c: F.col(c).cast("double").alias("value")
    return cv.select(F.lit("mean").alias("name"), "metric", "split", number("mean")) \
        .unionByName(cv.select(F.lit("std").alias("name"), "metric", "split", number("std"))) \
        .unionByName(read("evaluation").select(F.lit("evaluation").alias("name"), F.lit("roc_auc").alias("metric"), F.lit("test").alias("split"), number("roc_auc"))) \
        .unionByName(read("importance").select(F.lit("importance").alias("name"), F.col("feature").alias("metric"), F.lit(None).cast("string").alias("split"),
                                               number("importance")))


_TT = _CV.replace("FROM scored)", "FROM sp)").replace("FROM fd, range(5) t(i))", "FROM fd, range(5) t(i) WHERE split = 'train')")
register(Query(
    "training_tables_two", _tables_two, operators="IO-3 ML-7 ML-8 ML-9", floats=["value"], digits={"value": 4},
    ctes=f"{_SPLIT},\n{_TT}" + f""",
pm AS MATERIALIZED (SELECT out_fold AS fold, defaulted, {_PROB} AS p, CASE WHEN fold = out_fold THEN 'test' ELSE 'train' END AS part
  FROM fm JOIN fit ON fit.g = out_fold JOIN st ON st.g = out_fold),
pr AS MATERIALIZED (SELECT *, {_rank_sql('p', 'fold, part')} AS r FROM pm),
ms AS (SELECT fold, part AS split, {_AUC_OF} AS roc_auc, -avg(CASE WHEN defaulted = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss FROM pr GROUP BY fold, part),
cv AS (SELECT metric, split, avg(value) AS mean, stddev_pop(value) AS std FROM ms UNPIVOT (value FOR metric IN (roc_auc, log_loss)) GROUP BY metric, split),
rf AS MATERIALIZED (WITH st AS MATERIALIZED {_STATS}, lr AS MATERIALIZED {_ROWS}, {newton_sql("lr", "once")} SELECT * FROM once, st),
ev AS (SELECT {_AUC_OF} AS auc FROM (SELECT defaulted, {_rank_sql('p')} AS r FROM (SELECT defaulted, {_PROB} AS p FROM sp, rf WHERE split = 'test')))""",
    sql="""SELECT 'mean' AS name, metric, split, mean AS value FROM cv UNION ALL SELECT 'std', metric, split, std FROM cv
UNION ALL SELECT 'evaluation', 'roc_auc', 'test', auc FROM ev
UNION ALL SELECT 'importance', 'CreditScore', NULL, abs(b1) FROM rf UNION ALL SELECT 'importance', 'Income', NULL, abs(b2) FROM rf"""))

# -- ML-10 -----------------------------------------------------------------------------

_FROZEN = {"score": "risk_score", "credit": "1 - CreditScore / 1e3", "noise": "((app_id * 7919) % 1009) / 1e3"}


def _best_frozen(spark, sf):
    """Three frozen scores as models: metrics by fold, then the selection."""
    d = cut_lineage(S.stratified_folds(X.scored(spark, sf), TARGET, "app_id"))
    fm = None
    for name, expr in _FROZEN.items():
        one = T.fold_metrics(d.withColumn("p", F.expr(expr)), "fold", "defaulted", "p") \
            .withColumn("model", F.lit(name)).withColumn("split", F.lit("test"))
        fm = one if fm is None else fm.unionByName(one)
    summary = cut_lineage(T.aggregate_cv(fm, ["model", "split"]))
    best = T.select_best(summary, list(_FROZEN))
    return summary.where("metric = 'roc_auc'").select("model", "mean", "std", (F.col("model") == F.lit(best)).alias("selected"))


register(Query(
    "select_model_frozen", _best_frozen, operators="ML-9 ML-10", floats=["mean", "std"],
    ctes=f"fd AS MATERIALIZED (SELECT *, {_FOLD} AS fold FROM scored),\nfr AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS model, fold, defaulted, {e} AS p FROM fd" for n, e in _FROZEN.items()) + f"""),
au AS (SELECT model, fold, {_AUC_OF} AS auc FROM (SELECT *, {_rank_sql('p', 'model, fold')} AS r FROM fr) GROUP BY model, fold),
ms AS (SELECT model, avg(auc) AS mean, stddev_pop(auc) AS std FROM au GROUP BY model)""",
    sql="SELECT model, mean, std, mean = max(mean) OVER () AS selected FROM ms"))

# -- ML-12 -----------------------------------------------------------------------------

_TRIALS = 3


def _search_two(spark, sf):
    d = cut_lineage(S.stratified_folds(X.scored(spark, sf), TARGET, "app_id"))
    r = T.random_search(d, "logistic_regression", TWO, [], n_trials=_TRIALS)
    return r.select("trial", "state", "folds", F.posexplode("fold_roc_auc").alias("fold", "roc_auc"))


_C_OF = [SE.propose(SE.SPACES["logistic_regression"], [], np.random.default_rng([T.SEED, i]), _TRIALS)["C"] for i in range(_TRIALS)]
_RS_STATS, _RS_ROWS = _scaled_sql("tm", "fold <> out_fold", "trial * 5 + out_fold", "ridge_of")
register(Query(
    "random_search_two", _search_two, operators="ML-12", floats=["roc_auc"],
    # the trials' penalties, drawn from the seed alone, are fixed values here
    ctes=f"""tr AS (SELECT * FROM (VALUES {', '.join(f'({i}, {1 / c!r}::DOUBLE)' for i, c in enumerate(_C_OF))}) AS t(trial, ridge_of)),
fd AS MATERIALIZED (SELECT *, {_FOLD} AS fold FROM scored),
tm AS MATERIALIZED (SELECT fd.*, CAST(i AS INTEGER) AS out_fold, trial, ridge_of FROM fd, range(5) t(i), tr),
st AS MATERIALIZED {_RS_STATS},
lr AS MATERIALIZED {_RS_ROWS},
""" + newton_sql("lr", "fit") + f""",
pm AS (SELECT trial, fold, defaulted, {_PROB} AS p FROM tm JOIN fit ON fit.g = trial * 5 + fold JOIN st ON st.g = fit.g WHERE fold = out_fold)""",
    sql=f"""SELECT CAST(trial AS INTEGER) AS trial, 'complete' AS state, CAST(5 AS INTEGER) AS folds, fold, {_AUC_OF} AS roc_auc
FROM (SELECT *, {_rank_sql('p', 'trial, fold')} AS r FROM pm) GROUP BY trial, fold"""))


def _tpe(spark, sf):
    d = cut_lineage(S.stratified_folds(X.scored(spark, sf), TARGET, "app_id"))
    return T.hyper_search(d, "logistic_regression", NUMERIC, [], n_trials=16)


register(Query("tpe_search", _tpe, operators="ML-12"))

# -- ML-5, ML-6, ML-14 -----------------------------------------------------------------

TREE_BINS = 16


def boost_sql(rounds: int, p: B.TreeParams, train: str) -> str:
    """CTEs of ``rounds`` trees over the rows ``train`` (app_id, y, b: list of
    bins, m: margin): per split the best of all leaves. ``v{r}``: (node, G, H,
    n) of the leaves of tree r, ``x{r}_{s}``: its splits, ``m{r}``: margins."""
    shrink = lambda g: f"sign({g}) * greatest(abs({g}) - {p.l1!r}, 0)"
    gain = lambda g, h: f"(({shrink(g)}) * ({shrink(g)}) / ({h} + {p.l2!r}))"
    ctes = [f"m0 AS MATERIALIZED (SELECT app_id, y, b, m FROM {train})"]
    width = len(NUMERIC)
    for r in range(1, rounds + 1):
        ctes.append(f"""n{r}_0 AS MATERIALIZED (SELECT app_id, b, CAST(1 AS BIGINT) AS node, CAST(round((q - y) * {B.UNIT}) AS BIGINT) AS gi,
  CAST(round(q * (1 - q) * {B.UNIT}) AS BIGINT) AS hi FROM (SELECT *, 1 / (1 + exp(-m)) AS q FROM m{r - 1}))""")
        for s in range(1, p.max_leaves):
            ctes.append(f"""h{r}_{s} AS MATERIALIZED (SELECT node, f, b[f + 1] AS bin, sum(gi) AS gi, sum(hi) AS hi, count(*) AS n
  FROM n{r}_{s - 1}, range({width}) t(f) GROUP BY ALL)""")
            ctes.append(f"""x{r}_{s} AS MATERIALIZED (SELECT node, f, cut, n, {gain('gl', 'hl')} + {gain('gt - gl', 'ht - hl')} - {gain('gt', 'ht')} AS gain
  FROM (SELECT node, f, bin AS cut, CAST(sum(gi) OVER w AS DOUBLE) / {B.UNIT} AS gl, CAST(sum(hi) OVER w AS DOUBLE) / {B.UNIT} AS hl, sum(n) OVER w AS nl,
    CAST(sum(gi) OVER a AS DOUBLE) / {B.UNIT} AS gt, CAST(sum(hi) OVER a AS DOUBLE) / {B.UNIT} AS ht, sum(n) OVER a AS n FROM h{r}_{s}
    WINDOW a AS (PARTITION BY node, f), w AS (PARTITION BY node, f ORDER BY bin))
  WHERE nl >= {p.min_rows} AND n - nl >= {p.min_rows} AND hl >= {p.min_hessian!r} AND ht - hl >= {p.min_hessian!r} AND node < {2 ** p.max_depth}
    AND {gain('gl', 'hl')} + {gain('gt - gl', 'ht - hl')} - {gain('gt', 'ht')} > 1e-12
  ORDER BY gain DESC, node, f, cut LIMIT 1)""")
            ctes.append(f"""n{r}_{s} AS MATERIALIZED (SELECT app_id, b, CASE WHEN t.node = x.node THEN 2 * t.node + CAST(b[f + 1] > cut AS INTEGER) ELSE t.node END AS node,
  gi, hi FROM n{r}_{s - 1} t LEFT JOIN x{r}_{s} x ON true)""")
        last = f"n{r}_{p.max_leaves - 1}"
        ctes.append(f"""v{r} AS MATERIALIZED (SELECT node, g, h, n, -({shrink('g')}) / (h + {p.l2!r}) * {p.learning_rate!r} AS value
  FROM (SELECT node, CAST(sum(gi) AS DOUBLE) / {B.UNIT} AS g, CAST(sum(hi) AS DOUBLE) / {B.UNIT} AS h, count(*) AS n FROM {last} GROUP BY node))""")
        if r < rounds:
            ctes.append(f"""m{r} AS MATERIALIZED (SELECT t.app_id, y, t.b, m + value AS m FROM m{r - 1} t JOIN {last} n ON t.app_id = n.app_id
  JOIN v{r} ON n.node = v{r}.node)""")
    return ",\n".join(ctes)


def _bins_sql(src: str, fit: str) -> str:
    probs = "[" + ", ".join(f"{i / TREE_BINS!r}" for i in range(1, TREE_BINS)) + "]"
    edges = ", ".join(f"list_distinct(quantile_cont(CAST({c} AS DOUBLE), {probs})) AS e{i}" for i, c in enumerate(NUMERIC))
    bins = ", ".join(f"len(list_filter(e{i}, lambda e: e < {c}))" for i, c in enumerate(NUMERIC))
    return f"""eg AS MATERIALIZED (SELECT {edges}, ln(CAST(sum(defaulted) AS DOUBLE) / sum(1 - defaulted)) AS start FROM {fit}),
bn AS MATERIALIZED (SELECT s.*, CAST(defaulted AS DOUBLE) AS y, [{bins}] AS b, start AS m FROM {src} s, eg)"""


_ONE = B.TreeParams(n_estimators=1, subsample=1.0, colsample=1.0, max_bins=TREE_BINS)


def _first_tree(spark, sf):
    """The first tree of the preset with 31 leaves: gain of every split, rows
    and value of every leaf."""
    model = B.fit_boosted(X.scored(spark, sf), NUMERIC, "defaulted", "app_id", _ONE)
    t = B.trees_table(spark, model)
    return t.select("node", "feature", "gain", "value", F.col("cover").alias("rows"))


_NAMES = "[" + ", ".join(f"'{c}'" for c in NUMERIC) + "]"
register(Query(
    "boosted_first_tree", _first_tree, operators="ML-6", floats=["gain", "value"],
    ctes=_bins_sql("scored", "scored") + ",\n" + boost_sql(1, _ONE, "bn"),
    sql="\nUNION ALL ".join([f"SELECT node, {_NAMES}[f + 1] AS feature, gain, CAST(NULL AS DOUBLE) AS value, CAST(n AS BIGINT) AS rows FROM x1_{s}"
                             for s in range(1, _ONE.max_leaves)] + ["SELECT node, NULL, NULL, value, n FROM v1"])))

_STOP = B.TreeParams(n_estimators=6, learning_rate=0.9, max_leaves=4, max_depth=6, min_rows=1, min_hessian=1.0, l1=0.5, subsample=1.0,
                     colsample=1.0, max_bins=TREE_BINS)
_PATIENCE = 1


def _early_stop(spark, sf):
    """Boosting with patience: validation ROC-AUC by round and the rounds kept."""
    sp = cut_lineage(S.stratified_split(X.scored(spark, sf), TARGET, "app_id", S.SPLIT_701515))
    model = B.fit_boosted(sp.where("split = 'train'"), NUMERIC, "defaulted", "app_id", _STOP,
                          validation=sp.where("split = 'val'"), patience=_PATIENCE)
    rows = [(r, a, r <= len(model.trees)) for r, a in model.history]
    return literal_table(spark, rows, "round int, roc_auc double, kept boolean")


def _stop_sql() -> str:
    p = _STOP
    side = []
    for r in range(1, p.n_estimators + 1):
        walk = f"SELECT t.*, CAST(1 AS BIGINT) AS u FROM {'va' if r == 1 else f'w{r - 1}'} t"
        for s in range(1, p.max_leaves):
            walk = f"SELECT t.* EXCLUDE (u), CASE WHEN u = node THEN 2 * u + CAST(b[f + 1] > cut AS INTEGER) ELSE u END AS u FROM ({walk}) t LEFT JOIN (SELECT node, f, cut FROM x{r}_{s}) x ON true"
            walk = f"SELECT app_id, defaulted, b, m, u FROM ({walk}) t"
        side.append(f"w{r} AS MATERIALIZED (SELECT app_id, defaulted, b, m + value AS m FROM ({walk}) t JOIN v{r} ON u = node)")
    return ",\n".join(side)


register(Query(
    "boosted_early_stop", _early_stop, operators="ML-5 ML-14", floats=["roc_auc"],
    ctes=f"sp AS MATERIALIZED ({_split_sql('scored', [('train', 7000), ('val', 8500), ('test', 10000)])}),\n"
         + _bins_sql("sp", "(SELECT * FROM sp WHERE split = 'train')")
         + ",\ntn AS (SELECT app_id, y, b, m FROM bn WHERE split = 'train'),\nva AS (SELECT app_id, defaulted, b, m FROM bn WHERE split = 'val'),\n"
         + boost_sql(_STOP.n_estimators, _STOP, "tn") + ",\n" + _stop_sql() + ",\nau AS (" + " UNION ALL ".join(
             f"SELECT CAST({r} AS INTEGER) AS round, {_AUC_OF} AS auc FROM (SELECT defaulted, {_rank_sql('m')} AS r FROM w{r})" for r in range(1, _STOP.n_estimators + 1))
         + """),
bs AS (SELECT *, auc > coalesce(max(auc) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS better FROM au),
lb AS (SELECT *, max(CASE WHEN better THEN round END) OVER (ORDER BY round) AS last FROM bs),
"""
         + f"st AS (SELECT coalesce(min(CASE WHEN round - last >= {_PATIENCE} THEN last END), max(last)) AS best FROM lb)",
    sql="SELECT round, auc AS roc_auc, round <= best AS kept FROM au, st"))


def _leafwise(spark, sf):
    """ML-6 / ML-7: the preset with 31 leaves on prepared features, 10 rounds."""
    sp = _two_split(spark, sf)
    m = T.fit_model(sp.where(F.col("split") == "train"), "boosted_leafwise", NUMERIC, X.CATEGORICAL, params={"n_estimators": 10})
    te = cut_lineage(m.score(sp.where(F.col("split") == "test")).select("defaulted", "probability_default"))
    return V.evaluation_report(te, "defaulted", "probability_default").withColumn("model", F.lit("boosted_leafwise"))


register(Query("boosted_leafwise_holdout", _leafwise, operators="ML-6 ML-7"))


def _contributions(spark, sf):
    """SC-6: a boosted model's contributions for every application, its five
    largest; what they add up to is compared with the margin."""
    d = cut_lineage(X.scored(spark, sf).select("app_id", "defaulted", *NUMERIC))
    model = B.fit_boosted(d, NUMERIC, "defaulted", "app_id", B.replace(_ONE, n_estimators=5))
    e = B.tree_contributions(d, model, ["app_id"])
    total = F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["value"])
    top = B.top_contributions(e.withColumn("gap", F.round(total - F.col("margin"), 9) + 0.0), 3)
    return top.select("app_id", "margin", "base_value", "gap", F.array_join(F.transform(
        "contributions", lambda c: F.concat(c["feature"], F.lit("="), F.round(c["value"], 4).cast("string"))), ";").alias("top"))


register(Query("tree_contributions", _contributions, operators="SC-6"))

# -- ML-13 -----------------------------------------------------------------------------

def _minority(spark, sf):
    return O.scaled(X.scored(spark, sf).where("defaulted = 1"), NUMERIC)


def _neighbours(spark, sf):
    return O.nearest_neighbours(cut_lineage(_minority(spark, sf)), "app_id", [f"__s_{c}" for c in NUMERIC])


_RANGE = ", ".join(f"min(CAST({c} AS DOUBLE)) AS a{i}, max(CAST({c} AS DOUBLE)) AS b{i}" for i, c in enumerate(NUMERIC))
_UNIT = ", ".join(f"({c} - a{i}) / (b{i} - a{i}) AS s{i}" for i, c in enumerate(NUMERIC))
_GAP = " + ".join(f"(x.s{i} - y.s{i}) * (x.s{i} - y.s{i})" for i in range(len(NUMERIC)))
_KNN = f"""mi AS MATERIALIZED (SELECT * FROM scored WHERE defaulted = 1),
un AS MATERIALIZED (SELECT app_id, {_UNIT} FROM mi, (SELECT {_RANGE} FROM mi)),
pr AS (SELECT x.app_id, y.app_id AS neighbour, {_GAP} AS gap FROM un x JOIN un y ON x.app_id <> y.app_id),
nn AS MATERIALIZED (SELECT app_id, unnest(list_slice(list_sort(list({{'gap': gap, 'neighbour': neighbour}})), 1, 5)) AS n, generate_subscripts(list_slice(list_sort(list({{'gap': gap, 'neighbour': neighbour}})), 1, 5), 1) AS rank FROM pr GROUP BY app_id)"""
register(Query(
    "minority_neighbours", _neighbours, operators="ML-13", floats=["distance"], ctes=_KNN,
    sql="SELECT app_id, CAST(rank AS INTEGER) AS rank, n.neighbour AS neighbour, sqrt(n.gap) AS distance FROM nn"))


def _oversampled(spark, sf):
    d = cut_lineage(X.scored(spark, sf).select("app_id", "defaulted", *NUMERIC, "City"))
    out = O.oversample_minority(d, "defaulted", "app_id", NUMERIC)
    return out.where("synthetic").select("base", "neighbour", "share", "defaulted", *NUMERIC, "City")


_MIX = ", ".join(f"CAST(x.{c} AS DOUBLE) + share * (CAST(y.{c} AS DOUBLE) - CAST(x.{c} AS DOUBLE)) AS {c}" for c in NUMERIC)
register(Query(
    "minority_oversample", _oversampled, operators="ML-13", floats=["share", *NUMERIC],
    ctes=_KNN + """,
bs AS (SELECT app_id, row_number() OVER (ORDER BY md5(CAST(app_id AS VARCHAR) || '|42'), app_id) AS rn, count(*) OVER () AS n,
  (SELECT count_if(defaulted = 0) - count_if(defaulted = 1) FROM scored) AS extra FROM mi),
cp AS (SELECT app_id, unnest(range(CAST(extra // n + CASE WHEN rn <= extra % n THEN 1 ELSE 0 END AS BIGINT))) AS copy FROM bs),
hs AS (SELECT app_id, md5(CAST(app_id AS VARCHAR) || '|' || copy || '|42') AS h FROM cp),
pk AS (SELECT app_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 5 + 1 AS rank, CAST('0x' || substr(h, 9, 8) AS BIGINT) / 4294967296e0 AS share FROM hs)""",
    sql=f"""SELECT pk.app_id AS base, n.neighbour AS neighbour, share, x.defaulted, {_MIX}, x.City AS City
FROM pk JOIN nn ON pk.app_id = nn.app_id AND pk.rank = nn.rank JOIN mi x ON x.app_id = pk.app_id JOIN mi y ON y.app_id = n.neighbour"""))
