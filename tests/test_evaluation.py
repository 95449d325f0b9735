import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import evaluation as V


def scores(spark, n=800, seed=3, ties=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = rnd.randint(0, 1)
        s = min(max(rnd.gauss(0.35 + 0.3 * y, 0.2), 0.0), 1.0)
        if ties:
            s = round(s, 2)
        rows.append((i, y, s))
    return spark.createDataFrame(rows, "id long, defaulted int, risk_score double"), rows


def brute_auc(rows):
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    tot = sum((1.0 if p > q else 0.5 if p == q else 0.0) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def test_auc_ties_half_and_symmetry(spark):
    df, rows = scores(spark)
    r = V.ranking_metrics(df).first()
    assert r["roc_auc"] == pytest.approx(brute_auc(rows), abs=1e-12)
    flipped = df.withColumn("risk_score", 1 - F.col("risk_score"))
    assert V.ranking_metrics(flipped).first()["roc_auc"] == pytest.approx(1 - r["roc_auc"], abs=1e-12)


def test_pr_auc_trapezoid_from_recall_zero(spark):
    df, rows = scores(spark)
    got = V.ranking_metrics(df).first()["pr_auc"]
    P = sum(y for _, y, _ in rows)
    pts = [(0.0, 1.0)]
    for t in sorted({s for *_, s in rows}, reverse=True):
        tp = sum(1 for _, y, s in rows if s >= t and y == 1)
        fp = sum(1 for _, y, s in rows if s >= t and y == 0)
        pts.append((tp / P, tp / (tp + fp)))
    area = sum((r1 - r0) * (p1 + p0) / 2 for (r0, p0), (r1, p1) in zip(pts, pts[1:]))
    assert got == pytest.approx(area, abs=1e-12)


def test_ks_and_roc_curve(spark):
    df, rows = scores(spark)
    roc = V.roc_curve(df).collect()
    ks = V.ranking_metrics(df).first()["ks"]
    assert ks == pytest.approx(max(abs(r["tpr"] - r["fpr"]) for r in roc))
    assert max(r["tpr"] for r in roc) == 1.0 and max(r["fpr"] for r in roc) == 1.0


def test_confusion_and_zero_division(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "defaulted int, risk_score double")
    r = V.confusion(df).first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"]) == (0, 2, 0, 0)
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["mcc"] == 0.0 and r["npv"] == 1.0


def test_log_loss_clipping(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.5)], "defaulted int, risk_score double")
    got = V.log_loss(df).first()["log_loss"]
    assert got == pytest.approx(-(math.log(0.5)) / 3, rel=1e-9)


def test_calibration_bins_right_closed(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.1), (1, 0.1000001), (1, 1.0)], "defaulted int, risk_score double")
    got = {r["bin"]: r["count"] for r in V.calibration_curve(df).collect()}
    assert got == {0: 2, 1: 1, 9: 1}


def test_threshold_metrics_match_single(spark):
    df, _ = scores(spark)
    multi = {r["threshold"]: r for r in V.threshold_metrics(df, [0.3, 0.5, 0.7]).collect()}
    for t in (0.3, 0.5, 0.7):
        one = V.confusion(df, threshold=t).first()
        assert (multi[t]["tp"], multi[t]["fp"], multi[t]["tn"], multi[t]["fn"]) == (one["tp"], one["fp"], one["tn"], one["fn"])
