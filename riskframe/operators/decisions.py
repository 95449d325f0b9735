"""DEC-1..13: decision policy, portfolio impact, threshold sweeps, segments,
pricing and fairness -- all single-pass conditional aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (APPROVE, REJECT, REVIEW, band_expr, decision_code_expr,
                                 decision_expr, literal_table, safe_div)
from .ordered import quantile_row

# Threshold grid of the sweep (fixed values): 0.1 + 0.05 * i for i = 0..15,
# every pair with approve < reject (120 pairs).
GRID_START, GRID_STEP, GRID_N = 0.1, 0.05, 16

# Business constraints of the policy configuration (fixed values).
CONSTRAINTS = {"min_approval_rate": 0.50, "max_default_rate": 0.20}


def grid_thresholds() -> list[float]:
    return [GRID_START + GRID_STEP * i for i in range(GRID_N)]


def apply_policy(df: DataFrame, score_col: str = "risk_score", approve: float = 0.30,
                 reject: float = 0.70, out: str = "decision") -> DataFrame:
    """DEC-1: adds ``decision`` (APPROVE/REVIEW/REJECT) and ``decision_code`` (1/0/-1)."""
    return (df.withColumn(out, decision_expr(score_col, approve, reject))
            .withColumn(f"{out}_code", decision_code_expr(out)))


def _impact_aggs(decision: Column, y: Column, score: Column, amount: Column | None,
                 review_counts_as_approved: bool) -> list[Column]:
    approved = (decision != F.lit(REJECT)) if review_counts_as_approved else (decision == F.lit(APPROVE))
    y = y.cast("long")
    aggs = [
        F.count(F.lit(1)).alias("total_applicants"),
        F.count_if(approved).alias("approved_count"),
        F.count_if(decision == F.lit(REVIEW)).alias("reviewed_count"),
        F.count_if(decision == F.lit(REJECT)).alias("rejected_count"),
        F.coalesce(F.sum(F.when(approved, y)), F.lit(0)).cast("long").alias("approved_defaults"),
        F.coalesce(F.sum(F.when(decision == F.lit(REJECT), y)), F.lit(0)).cast("long")
         .alias("rejected_defaults"),
        F.coalesce(F.sum(y), F.lit(0)).cast("long").alias("__defaults"),
    ]
    if amount is not None:
        aggs += [F.coalesce(F.sum(F.when(approved, score * amount)), F.lit(0.0)).alias("expected_loss_approved"),
                 F.coalesce(F.sum(score * amount), F.lit(0.0)).alias("expected_loss_total")]
    else:
        aggs += [F.lit(None).cast("double").alias("expected_loss_approved"),
                 F.lit(None).cast("double").alias("expected_loss_total")]
    return aggs


IMPACT_COLS = ["total_applicants", "approved_count", "reviewed_count", "rejected_count",
               "approval_rate", "approved_defaults", "default_rate_in_approved",
               "false_negative_rate", "rejected_defaults", "expected_loss_approved",
               "expected_loss_total"]


def _impact_rates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(
        *keys, "total_applicants", "approved_count", "reviewed_count", "rejected_count",
        safe_div(F.col("approved_count"), F.col("total_applicants")).alias("approval_rate"),
        "approved_defaults",
        safe_div(F.col("approved_defaults"), F.col("approved_count")).alias("default_rate_in_approved"),
        safe_div(F.col("approved_defaults"), F.col("__defaults")).alias("false_negative_rate"),
        "rejected_defaults", "expected_loss_approved", "expected_loss_total")


def business_impact(df: DataFrame, decision_col: str = "decision", default_col: str = "defaulted",
                    score_col: str = "risk_score", amount_col: str | None = "LoanAmount",
                    review_counts_as_approved: bool = True, by: list[str] | None = None) -> DataFrame:
    """DEC-2: one row (per ``by`` group) of portfolio metrics. Approved means
    "not rejected" by default (the reference counts REVIEW as approved)."""
    by = by or []
    amount = F.col(amount_col) if amount_col else None
    agg = df.groupBy(*by).agg(*_impact_aggs(F.col(decision_col), F.col(default_col),
                                            F.col(score_col), amount, review_counts_as_approved))
    return _impact_rates(agg, by)


def _cells(df: DataFrame, score_col: str, thresholds: list[float], default_col: str,
           amount_col: str | None) -> DataFrame:
    """Collapse rows to cells (lo, le): lo = #thresholds < s, le = #thresholds <= s.
    At most 2m+1 cells for m sorted thresholds; NULL/NaN scores go to the
    cell (0, m) which is REVIEW for every pair."""
    s = F.col(score_col)
    ok = s.isNotNull() & ~F.isnan(s)
    m = len(thresholds)
    lo = sum(F.when(s > F.lit(t), 1).otherwise(0) for t in thresholds)
    le = sum(F.when(s >= F.lit(t), 1).otherwise(0) for t in thresholds)
    amt = F.col(amount_col) if amount_col else F.lit(None).cast("double")
    return (df.select(F.when(ok, lo).otherwise(0).alias("lo"), F.when(ok, le).otherwise(m).alias("le"),
                      F.col(default_col).cast("long").alias("y"), (s * amt).alias("el"))
            .groupBy("lo", "le")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("yd"), F.sum("el").alias("el")))


def sweep_pairs(df: DataFrame, pairs: DataFrame, thresholds: list[float], score_col: str = "risk_score",
                default_col: str = "defaulted", amount_col: str | None = "LoanAmount",
                review_counts_as_approved: bool = True) -> DataFrame:
    """Evaluate DEC-2 for many (approve, reject) pairs with one scan.

    ``pairs`` has (pair_id, ai, ri, approve_threshold, reject_threshold) where
    ai / ri index the sorted ``thresholds``. Rows are collapsed into <= 2m+1
    cells first, so the cross join is cells x pairs, never rows x pairs."""
    cells = _cells(df, score_col, thresholds, default_col, amount_col)
    cp = cells.crossJoin(F.broadcast(pairs))
    rejected = F.col("lo") > F.col("ri")
    approve_only = ~(F.col("le") > F.col("ai"))
    decision = F.when(rejected, F.lit(REJECT)).when(approve_only, F.lit(APPROVE)).otherwise(F.lit(REVIEW))
    approved = (decision != F.lit(REJECT)) if review_counts_as_approved else (decision == F.lit(APPROVE))
    agg = cp.groupBy("pair_id", "approve_threshold", "reject_threshold").agg(
        F.sum("n").alias("total_applicants"),
        F.coalesce(F.sum(F.when(approved, F.col("n"))), F.lit(0)).cast("long").alias("approved_count"),
        F.coalesce(F.sum(F.when(decision == REVIEW, F.col("n"))), F.lit(0)).cast("long").alias("reviewed_count"),
        F.coalesce(F.sum(F.when(decision == REJECT, F.col("n"))), F.lit(0)).cast("long").alias("rejected_count"),
        F.coalesce(F.sum(F.when(approved, F.col("yd"))), F.lit(0)).cast("long").alias("approved_defaults"),
        F.coalesce(F.sum(F.when(decision == REJECT, F.col("yd"))), F.lit(0)).cast("long").alias("rejected_defaults"),
        F.coalesce(F.sum("yd"), F.lit(0)).cast("long").alias("__defaults"),
        (F.coalesce(F.sum(F.when(approved, F.col("el"))), F.lit(0.0)) if amount_col
         else F.lit(None).cast("double")).alias("expected_loss_approved"),
        (F.coalesce(F.sum("el"), F.lit(0.0)) if amount_col
         else F.lit(None).cast("double")).alias("expected_loss_total"))
    return _impact_rates(agg, ["pair_id", "approve_threshold", "reject_threshold"])


def threshold_sweep(df: DataFrame, score_col: str = "risk_score", default_col: str = "defaulted",
                    amount_col: str | None = "LoanAmount", review_counts_as_approved: bool = True) -> DataFrame:
    """DEC-5: all 120 grid pairs (approve < reject) with their DEC-2 metrics.
    ``pair_id`` follows the reference's loop order (approve-major)."""
    th = grid_thresholds()
    rows, pid = [], 0
    for i, a in enumerate(th):
        for j, r in enumerate(th):
            if i < j:
                rows.append((pid, i, j, a, r))
                pid += 1
    pairs = literal_table(df.sparkSession, rows,
                          "pair_id int, ai int, ri int, approve_threshold double, reject_threshold double")
    return sweep_pairs(df, pairs, th, score_col, default_col, amount_col, review_counts_as_approved)


def best_thresholds(sweep: DataFrame, metric: str = "approval_rate") -> DataFrame:
    """DEC-6: the optimal pair; ties go to the first pair in loop order. An
    unknown metric returns the first pair; expected loss without amounts raises."""
    if metric == "approval_rate":
        order = [F.col("approval_rate").desc()]
    elif metric == "default_rate":
        order = [F.col("default_rate_in_approved").asc()]
    elif metric == "expected_loss":
        # a sweep without amounts has the column, all NULL (at most 120 rows)
        if "expected_loss_approved" not in sweep.columns or not sweep.agg(F.count("expected_loss_approved")).first()[0]:
            raise ValueError("expected_loss needs loan amounts")
        order = [F.col("expected_loss_approved").asc_nulls_last()]
    else:
        order = []
    return sweep.orderBy(*order, F.col("pair_id").asc()).limit(1)


def constrained_best(sweep: DataFrame, max_default_rate: float = CONSTRAINTS["max_default_rate"],
                     min_approval_rate: float = CONSTRAINTS["min_approval_rate"]) -> DataFrame:
    """DEC-7: maximise approval subject to a default-rate cap and approval floor."""
    ok = sweep.where((F.col("default_rate_in_approved") <= F.lit(max_default_rate))
                     & (F.col("approval_rate") >= F.lit(min_approval_rate)))
    return ok.orderBy(F.col("approval_rate").desc(), F.col("default_rate_in_approved").asc(),
                      F.col("pair_id").asc()).limit(1)


def pareto_frontier(sweep: DataFrame) -> DataFrame:
    """DEC-7: pairs not dominated in (higher approval, lower default rate).
    The sweep has at most 120 rows, so one ordered window is fine here."""
    w = Window.orderBy(F.col("approval_rate").desc(), F.col("default_rate_in_approved").asc(),
                       F.col("pair_id").asc()).rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.min("default_rate_in_approved").over(w)
    return sweep.where(F.lit(True)).withColumn("__bb", best_before) \
        .where(F.col("__bb").isNull() | (F.col("default_rate_in_approved") < F.col("__bb"))).drop("__bb")


# Percentiles that shape the tradeoff curve (fixed values).
TRADEOFF_PCTS = [0.10, 0.25, 0.50, 0.75, 0.90]
TRADEOFF_STEPS = 25


def tradeoff_curve(df: DataFrame, score_col: str = "risk_score", default_col: str = "defaulted",
                   amount_col: str | None = "LoanAmount") -> DataFrame:
    """DEC-8: 25 approve thresholds evenly from min(score) to p75; reject =
    max(p90, approve + 0.1 * (p75 - p10)). The five percentiles and the
    minimum are a handful of numbers, fetched to build the threshold list."""
    # the exact 0-quantile is the minimum: one query gives all six numbers
    row = quantile_row(df.select(score_col), score_col, [0.0] + TRADEOFF_PCTS,
                       ["mn", "p10", "p25", "p50", "p75", "p90"]).first()
    p10, p75, p90, lo = row["p10"], row["p75"], row["p90"], row["mn"]
    n = TRADEOFF_STEPS
    step = (p75 - lo) / (n - 1)
    approves = [lo + k * step for k in range(n)]
    approves[-1] = p75
    rejects = [max(p90, a + (p75 - p10) * 0.1) for a in approves]
    th = sorted(set(approves) | set(rejects))
    idx = {t: i for i, t in enumerate(th)}
    rows = [(k, idx[a], idx[r], float(a), float(r)) for k, (a, r) in enumerate(zip(approves, rejects))]
    pairs = literal_table(df.sparkSession, rows,
                          "pair_id int, ai int, ri int, approve_threshold double, reject_threshold double")
    return sweep_pairs(df, pairs, th, score_col, default_col, amount_col)


def segment_stats(df: DataFrame, score_col: str = "risk_score", default_col: str | None = "defaulted",
                  preset: str = "segments", **band_kw) -> DataFrame:
    """DEC-3 + DEC-4: band every score, then count/mean/min/max score and the
    actual default rate per band."""
    b = df.withColumn("risk_segment", band_expr(score_col, preset, **band_kw) if not band_kw
                      else band_expr(score_col, None, **band_kw))
    aggs = [F.count(F.lit(1)).alias("count"), F.avg(score_col).alias("mean_score"),
            F.min(score_col).alias("min_score"), F.max(score_col).alias("max_score")]
    if default_col:
        aggs.append(F.avg(F.col(default_col).cast("double")).alias("actual_default_rate"))
    return b.groupBy("risk_segment").agg(*aggs)


def error_rates(df: DataFrame, decision_col: str = "decision", default_col: str = "defaulted") -> DataFrame:
    """DEC-9: good applicants rejected (false-positive rate), and precision /
    recall of rejection as a detector of defaults."""
    rej = F.col(decision_col) == F.lit(REJECT)
    y = F.col(default_col) == 1
    a = df.agg(F.count_if(rej & ~y).alias("good_rejected"), F.count_if(~y).alias("goods"),
               F.count_if(rej & y).alias("bad_rejected"), F.count_if(rej).alias("rejected"),
               F.count_if(y).alias("bads"))
    return a.select("good_rejected", "bad_rejected",
                    safe_div(F.col("good_rejected"), F.col("goods")).alias("false_positive_rate"),
                    safe_div(F.col("bad_rejected"), F.col("rejected")).alias("rejection_precision"),
                    safe_div(F.col("bad_rejected"), F.col("bads")).alias("rejection_recall"))


# Risk-based pricing and segment actions by quartile band (fixed values):
# band, interest rate %, action.
PRICING = [("Low Risk", 4.5, "auto_approve"), ("Moderate Risk", 5.5, "manual_review"),
           ("High Risk", 7.5, "conditional"), ("Very High Risk", None, "auto_reject")]


def price(df: DataFrame, score_col: str = "risk_score") -> DataFrame:
    """DEC-10: interest rate and segment action from the quartile band. The
    price table is 4 rows (fixed), broadcast."""
    t = literal_table(df.sparkSession, PRICING, "risk_band string, interest_rate double, segment_action string")
    return df.withColumn("risk_band", band_expr(score_col, "policy")) \
        .join(F.broadcast(t), "risk_band", "left")


# Loan-size thresholds (fixed values): small < 100K uses 0.40/0.75, large > 300K
# uses 0.25/0.65, others the default 0.30/0.70; above score 0.50 the amount is
# capped at 100K.
SIZE_RULES = {"small_max": 100_000.0, "large_min": 300_000.0,
              "small": (0.40, 0.75), "medium": (0.30, 0.70), "large": (0.25, 0.65),
              "cap_score": 0.50, "cap_amount": 100_000.0}


def size_aware_policy(df: DataFrame, score_col: str = "risk_score", amount_col: str = "LoanAmount",
                      rules: dict | None = None) -> DataFrame:
    """DEC-11: thresholds depend on the loan-size band; loans whose score is
    above the cap score are limited to the cap amount."""
    r = rules or SIZE_RULES
    amt, s = F.col(amount_col), F.col(score_col)
    size = (F.when(amt < F.lit(r["small_max"]), "small")
            .when(amt > F.lit(r["large_min"]), "large").otherwise("medium"))
    dec = (F.when(size == "small", decision_expr(s, *r["small"]))
           .when(size == "large", decision_expr(s, *r["large"]))
           .otherwise(decision_expr(s, *r["medium"])))
    capped = F.when(s > F.lit(r["cap_score"]), F.least(amt, F.lit(r["cap_amount"]))).otherwise(amt)
    return df.withColumn("size_band", size).withColumn("decision", dec) \
        .withColumn("approved_amount", capped)


def fairness_audit(df: DataFrame, groups: list[str], decision_col: str = "decision") -> DataFrame:
    """DEC-13: approval rate per value of each protected attribute, and its
    ratio to the best-treated value of the same attribute (disparate impact).
    One scan: grouping sets over the attributes."""
    approve = (F.col(decision_col) == F.lit(APPROVE)).cast("long")
    lf = df.select(F.explode(F.array(*[F.struct(F.lit(g).alias("attribute"),
                                                F.col(g).cast("string").alias("group_value"))
                                       for g in groups])).alias("kv"), approve.alias("a"))
    agg = lf.groupBy("kv.attribute", "kv.group_value").agg(
        F.count(F.lit(1)).alias("applicants"), F.sum("a").alias("approved"))
    rated = agg.withColumn("approval_rate", F.col("approved") / F.col("applicants"))
    # best rate per attribute: one row per attribute (bounded), broadcast back;
    # no per-attribute window, so a high-cardinality attribute is never one task
    best = rated.groupBy("attribute").agg(F.max("approval_rate").alias("__best"))
    return rated.join(F.broadcast(best), "attribute") \
        .withColumn("ratio_to_max", safe_div(F.col("approval_rate"), F.col("__best"))).drop("__best")
