"""EV-1..15: exact classification metrics and curves.

Threshold metrics are conditional counts in one aggregation. Ranking metrics
(ROC-AUC, PR-AUC, KS, curves) read one distributed table of cumulative
positive / negative counts per distinct score (``ordered.value_cumsums``), so
no task ever sorts the whole score column."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import literal_table
from .ordered import value_cumsums
from .profile import decile_bins, decile_edges

EPS = sys.float_info.epsilon  # log-loss clipping (double machine epsilon)


def _y(c: str) -> Column:
    return F.col(c).cast("long")


def confusion_aggs(y: str, score: str, threshold: float) -> list[Column]:
    pred = F.col(score) >= F.lit(float(threshold))
    pos = _y(y) == 1
    return [F.count_if(pred & pos).alias("tp"), F.count_if(~pred & ~pos).alias("tn"),
            F.count_if(pred & ~pos).alias("fp"), F.count_if(~pred & pos).alias("fn")]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def metrics_from_confusion(df: DataFrame) -> DataFrame:
    """EV-2/EV-3 on a frame with tp, tn, fp, fn: 0 for empty denominators."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    prec, rec = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return df.select(
        "*", _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), prec.alias("precision"),
        rec.alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tn, tn + fp).alias("specificity"), _ratio(tn, tn + fn).alias("npv"),
        F.when(den == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / den).alias("mcc"))


def confusion(df: DataFrame, y: str = "defaulted", score: str = "risk_score",
              threshold: float = 0.5) -> DataFrame:
    """EV-1..3: confusion matrix at ``score >= threshold`` and its rates."""
    return metrics_from_confusion(df.agg(*confusion_aggs(y, score, threshold))) \
        .withColumn("threshold", F.lit(float(threshold)))


def log_loss(df: DataFrame, y: str = "defaulted", score: str = "risk_score") -> DataFrame:
    """EV-4: mean binary cross-entropy, probabilities clipped to [eps, 1-eps]."""
    p = F.least(F.greatest(F.col(score), F.lit(EPS)), F.lit(1 - EPS))
    yy = _y(y).cast("double")
    return df.agg((-F.avg(yy * F.log(p) + (1 - yy) * F.log(1 - p))).alias("log_loss"))


def score_cumsums(df: DataFrame, y: str = "defaulted", score: str = "risk_score") -> DataFrame:
    """Distinct score -> pos, neg and their cumulative counts (both directions)."""
    d = df.where(F.col(score).isNotNull() & _y(y).isNotNull())
    c = value_cumsums(d, [score], {"pos": _y(y), "neg": F.lit(1) - _y(y)})
    return c.select(
        F.col("value").alias("threshold"), "pos", "neg",
        (F.col("pos_tot") - F.col("pos_lt")).alias("tp"), (F.col("neg_tot") - F.col("neg_lt")).alias("fp"),
        (F.col("pos_tot") - F.col("pos_le")).alias("tp_above"), (F.col("neg_tot") - F.col("neg_le")).alias("fp_above"),
        "neg_lt", F.col("pos_tot").alias("P"), F.col("neg_tot").alias("N"))


def ranking_metrics(df: DataFrame, y: str = "defaulted", score: str = "risk_score") -> DataFrame:
    """EV-5/EV-6/EV-12 in one pass over the cumulative table: ROC-AUC (ties
    half), PR-AUC by trapezoid starting at (recall 0, precision 1), and KS."""
    c = score_cumsums(df, y, score)
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    # ANSI mode raises on x / 0: one-class inputs (P or N = 0) use try_divide
    rec, rec_prev = F.try_divide(F.col("tp"), P), F.try_divide(F.col("tp_above"), P)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    above = F.col("tp_above") + F.col("fp_above")
    prec_prev = F.when(above == 0, F.lit(1.0)).otherwise(F.col("tp_above") / above)
    a = c.agg(
        F.sum(F.col("pos") * (F.col("neg_lt") + F.col("neg") / 2.0)).alias("__s"),
        F.sum((rec - rec_prev) * (prec + prec_prev) / 2.0).alias("__pr"),
        F.max(F.abs(F.try_divide(F.col("tp"), P) - F.try_divide(F.col("fp"), N))).alias("__ks"),
        F.first("P").alias("P"), F.first("N").alias("N"))
    bad = (F.col("P") == 0) | (F.col("N") == 0) | F.col("P").isNull()
    return a.select(
        F.when(bad, F.lit(None).cast("double")).otherwise(F.col("__s") / (P * N)).alias("roc_auc"),
        F.when(F.col("P") == 0, F.lit(None).cast("double")).otherwise(F.col("__pr")).alias("pr_auc"),
        F.when(bad, F.lit(None).cast("double")).otherwise(F.col("__ks")).alias("ks"))


def roc_curve(df: DataFrame, y: str = "defaulted", score: str = "risk_score") -> DataFrame:
    """EV-7: one point per distinct score (every threshold, no collinear drop)."""
    c = score_cumsums(df, y, score)
    return c.select("threshold", "tp", "fp", F.try_divide(F.col("tp"), F.col("P").cast("double")).alias("tpr"),
                    F.try_divide(F.col("fp"), F.col("N").cast("double")).alias("fpr"))


def pr_curve(df: DataFrame, y: str = "defaulted", score: str = "risk_score") -> DataFrame:
    """EV-8: precision / recall per distinct score, down to the first
    threshold that reaches full recall."""
    c = score_cumsums(df, y, score)
    return c.where(F.col("tp_above") < F.col("P")).select(
        "threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("P")).alias("recall"))


# Inner bin edges of the 10-bin calibration curve (fixed values): numpy linspace(0, 1, 11)[1:-1].
CAL_EDGES = [float(x) for x in np.linspace(0.0, 1.0, 11)[1:-1]]


def calibration_curve(df: DataFrame, y: str = "defaulted", score: str = "risk_score",
                      edges: list[float] | None = None) -> DataFrame:
    """EV-9: uniform bins, right-closed ((e_i, e_{i+1}], 0 in the first);
    empty bins do not appear."""
    edges = edges or CAL_EDGES
    s = F.col(score)
    b = sum(F.when(s > F.lit(e), 1).otherwise(0) for e in edges)
    return df.where(s.isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(_y(y).cast("double")).alias("prob_true"),
        F.avg(s).alias("prob_pred"))


def calibration_errors(df: DataFrame, y: str = "defaulted", score: str = "risk_score") -> DataFrame:
    """EV-11: Brier score, expected and maximum calibration error (10 bins)."""
    cal = calibration_curve(df, y, score)
    gap = F.abs(F.col("prob_true") - F.col("prob_pred"))
    e = cal.agg(F.try_divide(F.sum(F.col("count") * gap), F.sum("count")).alias("ece"), F.max(gap).alias("mce"))
    brier = df.where(F.col(score).isNotNull()).agg(
        F.avg(F.pow(F.col(score) - _y(y).cast("double"), 2)).alias("brier"))
    return brier.crossJoin(e)


def threshold_metrics(df: DataFrame, thresholds: list[float] = (0.3, 0.5, 0.7), y: str = "defaulted",
                      score: str = "risk_score") -> DataFrame:
    """EV-10: EV-1..3 at several thresholds from one scan: rows collapse to
    (#thresholds <= score, label) cells, then cells x thresholds."""
    th = sorted(float(t) for t in thresholds)
    s = F.col(score)
    le = sum(F.when(s >= F.lit(t), 1).otherwise(0) for t in th)
    cells = df.groupBy(le.alias("le"), _y(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    tt = literal_table(df.sparkSession, [(i, t) for i, t in enumerate(th)], "ti int, threshold double")
    cp = cells.crossJoin(F.broadcast(tt))
    pred, pos = F.col("le") > F.col("ti"), F.col("y") == 1
    agg = cp.groupBy("threshold").agg(
        F.coalesce(F.sum(F.when(pred & pos, F.col("n"))), F.lit(0)).cast("long").alias("tp"),
        F.coalesce(F.sum(F.when(~pred & ~pos, F.col("n"))), F.lit(0)).cast("long").alias("tn"),
        F.coalesce(F.sum(F.when(pred & ~pos, F.col("n"))), F.lit(0)).cast("long").alias("fp"),
        F.coalesce(F.sum(F.when(~pred & pos, F.col("n"))), F.lit(0)).cast("long").alias("fn"))
    return metrics_from_confusion(agg)


def lift_table(df: DataFrame, y: str = "defaulted", score: str = "risk_score") -> DataFrame:
    """EV-13: score deciles on exact decile edges (right-closed, ties share a
    decile), per decile count, defaults, default rate and lift over the
    overall rate."""
    edges = decile_edges(df, [score])
    b = df.select(decile_bins(df, [score], edges)[0].alias("decile"), _y(y).alias("y"))
    g = b.groupBy("decile").agg(F.count(F.lit(1)).alias("count"), F.sum("y").alias("defaults"))
    tot = g.agg((F.sum("defaults") / F.sum("count")).alias("__r"))
    return g.crossJoin(tot).select(
        "decile", "count", "defaults", (F.col("defaults") / F.col("count")).alias("default_rate"),
        F.when(F.col("__r") == 0, None).otherwise(F.col("defaults") / F.col("count") / F.col("__r")).alias("lift"))


def platt_scaling(train: DataFrame, y: str = "defaulted", score: str = "risk_score"):
    """EV-14: fit sigmoid(a * logit(score) + b) on labelled scores; returns
    the fitted one-feature model (apply with ``platt_transform``)."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-12)), F.lit(1 - 1e-12))
    d = train.select(F.log(p / (1 - p)).alias("__logit"), _y(y).cast("double").alias("__label"))
    va = VectorAssembler(inputCols=["__logit"], outputCol="__f")
    lr = LogisticRegression(featuresCol="__f", labelCol="__label", regParam=0.0, maxIter=100, tol=1e-9)
    return lr.fit(va.transform(d))


def platt_transform(model, df: DataFrame, score: str = "risk_score", out: str = "calibrated_score") -> DataFrame:
    a, b = float(model.coefficients[0]), float(model.intercept)
    p = F.least(F.greatest(F.col(score), F.lit(1e-12)), F.lit(1 - 1e-12))
    return df.withColumn(out, F.lit(1.0) / (1 + F.exp(-(F.lit(a) * F.log(p / (1 - p)) + F.lit(b)))))


def auc_by(df: DataFrame, group: str, y: str, score: str) -> dict:
    """Exact ROC-AUC (ties half) of every group, from one table of running
    sums; one row per group reaches the driver. None where a class is missing."""
    yy = _y(y)
    c = value_cumsums(df, [score], {"pos": yy, "neg": F.lit(1) - yy}, by=[group])
    auc = F.try_divide(F.sum(F.col("pos") * (F.col("neg_lt") + F.col("neg") / 2.0)), F.first("pos_tot") * F.first("neg_tot").cast("double"))
    return {r[group]: r["auc"] for r in c.groupBy(group).agg(auc.alias("auc")).collect()}


def evaluation_report(df: DataFrame, y: str = "defaulted", score: str = "risk_score",
                      threshold: float = 0.5) -> DataFrame:
    """EV-15: one row with roc_auc, pr_auc, log_loss, the EV-2 rates, MCC,
    confusion counts and the threshold (two scans: counts + cumulative)."""
    p = F.least(F.greatest(F.col(score), F.lit(EPS)), F.lit(1 - EPS))
    yy = _y(y).cast("double")
    base = df.agg(*confusion_aggs(y, score, threshold),
                  (-F.avg(yy * F.log(p) + (1 - yy) * F.log(1 - p))).alias("log_loss"))
    rm = ranking_metrics(df, y, score).select("roc_auc", "pr_auc")
    return metrics_from_confusion(base).crossJoin(rm).withColumn("threshold", F.lit(float(threshold)))
