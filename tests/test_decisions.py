import math

import pytest
from pyspark.sql import functions as F

from riskframe.operators import decisions as D


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, risk_score double, defaulted int, LoanAmount double")


def test_policy_boundaries_and_nan(spark):
    rows = [(1, 0.0, 0, 1.0), (2, 0.29999, 0, 1.0), (3, 0.3, 0, 1.0), (4, 0.7, 1, 1.0),
            (5, 0.70001, 1, 1.0), (6, 1.0, 1, 1.0), (7, float("nan"), 0, 1.0), (8, None, 0, 1.0)]
    got = {r["id"]: (r["decision"], r["decision_code"])
           for r in D.apply_policy(frame(spark, rows)).collect()}
    assert got[1] == ("APPROVE", 1) and got[2] == ("APPROVE", 1)
    assert got[3] == ("REVIEW", 0) and got[4] == ("REVIEW", 0)     # both bounds review
    assert got[5] == ("REJECT", -1) and got[6] == ("REJECT", -1)
    assert got[7] == ("REVIEW", 0) and got[8] == ("REVIEW", 0)     # NaN / NULL never reject


def test_documented_examples(spark):
    # response examples: 0.28 -> APPROVE, 0.62 -> REVIEW, 0.15 -> APPROVE
    df = frame(spark, [(1, 0.28, 0, 1.0), (2, 0.62, 0, 1.0), (3, 0.15, 0, 1.0)])
    assert [r["decision"] for r in D.apply_policy(df).orderBy("id").collect()] == ["APPROVE", "REVIEW", "APPROVE"]
    # expected loss example: 200K*.1 + 150K*.2 + 300K*.05 + 100K*.3 + 250K*.15 = 132.5K
    df = frame(spark, [(1, 0.10, 0, 200e3), (2, 0.20, 0, 150e3), (3, 0.05, 0, 300e3),
                       (4, 0.30, 0, 100e3), (5, 0.15, 0, 250e3)])
    r = D.business_impact(D.apply_policy(df)).first()
    assert r["expected_loss_total"] == pytest.approx(132.5e3)


def test_impact_rates_and_review_counts_as_approved(spark):
    df = frame(spark, [(1, 0.1, 0, 10.0), (2, 0.5, 1, 10.0), (3, 0.9, 1, 10.0), (4, 0.9, 0, 10.0)])
    d = D.apply_policy(df)
    r = D.business_impact(d).first()
    assert (r["approved_count"], r["reviewed_count"], r["rejected_count"]) == (2, 1, 2)
    assert r["approved_defaults"] == 1 and r["rejected_defaults"] == 1
    assert r["false_negative_rate"] == pytest.approx(0.5)
    strict = D.business_impact(d, review_counts_as_approved=False).first()
    assert strict["approved_count"] == 1 and strict["approved_defaults"] == 0
    # empty denominators give 0, missing amounts give NULL
    none = D.business_impact(D.apply_policy(frame(spark, [(1, 0.95, 0, 1.0)])), amount_col=None).first()
    assert none["default_rate_in_approved"] == 0.0 and none["expected_loss_total"] is None


def test_sweep_equals_brute_force(spark):
    import random
    rnd = random.Random(7)
    grid = D.grid_thresholds()
    rows = []
    for i in range(400):
        s = rnd.choice(grid) if i % 5 == 0 else round(rnd.random(), 3)   # many scores exactly on thresholds
        rows.append((i, s, rnd.randint(0, 1), float(rnd.randint(1, 100))))
    rows.append((999, None, 1, 5.0))
    df = frame(spark, rows)
    sweep = {r["pair_id"]: r for r in D.threshold_sweep(df).collect()}
    assert len(sweep) == 120
    for pid, r in sweep.items():
        brute = D.business_impact(D.apply_policy(df, approve=r["approve_threshold"],
                                                 reject=r["reject_threshold"])).first()
        for k in ("approved_count", "reviewed_count", "rejected_count", "approved_defaults", "rejected_defaults"):
            assert r[k] == brute[k], (pid, k)
        assert r["expected_loss_approved"] == pytest.approx(brute["expected_loss_approved"])
        if pid > 20:
            break


def test_best_threshold_ties_first_pair(spark):
    df = frame(spark, [(1, 0.05, 0, 1.0), (2, 0.95, 1, 1.0)])
    s = D.threshold_sweep(df)
    best = D.best_thresholds(s, "approval_rate").first()
    assert best["pair_id"] == 0  # every pair approves 50 %: first in loop order wins
    assert D.best_thresholds(s, "no_such_metric").first()["pair_id"] == 0


def test_bands_presets(spark):
    from riskframe.functions.columns import band_expr
    df = spark.createDataFrame([(0.0,), (0.3,), (0.7,), (1.0,), (0.2,), (0.8,)], "s double")
    got = df.select("s", band_expr("s", "predictor").alias("p"), band_expr("s", "segments").alias("g")).collect()
    m = {r["s"]: (r["p"], r["g"]) for r in got}
    assert m[0.0][0] is None                       # (0, .3]: zero falls outside
    assert m[0.3] == ("Low Risk", "Low Risk")
    assert m[0.7][0] == "Medium Risk" and m[1.0][0] == "High Risk"
    assert m[0.2][1] == "Low Risk" and m[0.8][1] == "Very High Risk"   # left-closed
