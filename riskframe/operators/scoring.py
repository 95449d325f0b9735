"""SC-1..7: batch scoring, decisions with explanations, batch statistics,
error routing, global and per-row explanations, extra outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import APPROVE, REJECT, REVIEW, band_expr, decision_expr
from .decisions import price
from .ordered import quantile_row
from .quality import RANGES


def batch_predict(fitted, df: DataFrame, target: str | None = "LoanApproved") -> DataFrame:
    """SC-1: drop the target, score, add class / probability / risk level
    (pd.cut-style bands (0, .3], (.3, .7], (.7, 1])."""
    x = df.drop(target) if target and target in df.columns else df
    s = fitted.score(x, out="probability")
    return s.withColumn("risk_level", band_expr("probability", "predictor"))


def _pct(x: Column, decimals: int) -> Column:
    """x as a percentage string with ``decimals`` places, rounded half-up on
    the scaled value (integer arithmetic, so every engine prints the same)."""
    if decimals == 0:
        return F.concat(F.round(x * 100.0).cast("long").cast("string"), F.lit("%"))
    scale = 10 ** decimals
    v = F.round(x * (100.0 * scale)).cast("long")
    return F.concat((v / scale).cast("long").cast("string"), F.lit("."),
                    F.lpad(F.pmod(v, F.lit(scale)).cast("string"), decimals, "0"), F.lit("%"))


def decide_and_explain(df: DataFrame, score_col: str = "risk_score", approve: float = 0.30,
                       reject: float = 0.70, decimals: int = 2) -> DataFrame:
    """SC-2: decision plus the explanation sentence (2 decimals as in the API,
    1 in the UI)."""
    s = F.col(score_col)
    d = decision_expr(s, approve, reject)
    r, a, j = _pct(s, decimals), _pct(F.lit(approve), 0), _pct(F.lit(reject), 0)
    text = (F.when(d == APPROVE, F.concat(F.lit("Risk score "), r, F.lit(" is below approval threshold ("), a, F.lit(")")))
            .when(d == REJECT, F.concat(F.lit("Risk score "), r, F.lit(" exceeds rejection threshold ("), j, F.lit(")")))
            .otherwise(F.concat(F.lit("Risk score "), r, F.lit(" requires manual review (between "), a,
                                F.lit("-"), j, F.lit(")"))))
    return df.withColumn("decision", d).withColumn("explanation", text)


def batch_statistics(decided: DataFrame, score_col: str = "risk_score", decision_col: str = "decision") -> DataFrame:
    """SC-3: n, mean / exact median / min / max score, decision counts and
    the approval rate (APPROVE only, as the batch endpoint counts it).
    Rows with decision ERROR count in n but not in the score statistics."""
    s, d = F.col(score_col), F.col(decision_col)
    a = decided.agg(F.count(F.lit(1)).alias("total_applicants"), F.avg(s).alias("mean_risk_score"),
                    F.min(s).alias("min_risk_score"), F.max(s).alias("max_risk_score"),
                    F.count_if(d == APPROVE).alias("n_approve"), F.count_if(d == REVIEW).alias("n_review"),
                    F.count_if(d == REJECT).alias("n_reject"), F.count_if(d == "ERROR").alias("n_error"))
    med = quantile_row(decided.select(score_col), score_col, [0.5], ["median_risk_score"])
    return a.crossJoin(med).withColumn(
        "approval_rate", F.when(F.col("total_applicants") == 0, 0.0)
        .otherwise(F.col("n_approve") / F.col("total_applicants")))


def route_errors(df: DataFrame, score_col: str = "risk_score", ranges: dict | None = None,
                 required: list[str] | None = None) -> DataFrame:
    """SC-4: a row with a missing required feature or a value outside its
    valid range gets decision ERROR (score NULL) and an error message instead
    of failing the whole batch."""
    ranges = ranges or RANGES
    required = required or list(ranges)
    problems = [F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in required if c in df.columns]
    problems += [F.when(~F.col(c).between(lo, hi), F.lit(f"{c} out of range")) for c, (lo, hi) in ranges.items()
                 if c in df.columns]
    err = F.concat_ws("; ", *problems)
    bad = err != ""
    out = decide_and_explain(df, score_col)
    return out.select(*[c for c in out.columns if c not in ("decision", "explanation", score_col)],
                      F.when(bad, None).otherwise(F.col(score_col)).alias(score_col),
                      F.when(bad, F.lit("ERROR")).otherwise(F.col("decision")).alias("decision"),
                      F.when(bad, err).otherwise(F.col("explanation")).alias("explanation"))


def processing_counts(routed: DataFrame) -> DataFrame:
    """SC-4: processed / failed counts."""
    return routed.agg(F.count(F.lit(1)).alias("submitted"),
                      F.count_if(F.col("decision") != "ERROR").alias("processed"),
                      F.count_if(F.col("decision") == "ERROR").alias("failed"))


def attach_top_features(scored: DataFrame, top: DataFrame, n: int = 5) -> DataFrame:
    """SC-5: the model's n most important features (global; a table of n rows,
    so broadcasting it is bounded) attached to every prediction as an array."""
    arr = top.orderBy("rank").limit(n).agg(
        F.collect_list(F.struct("feature", F.col("value").alias("coefficient"))).alias("top_features"))
    return scored.crossJoin(F.broadcast(arr))


# The fixture's score is a logistic model (fixed values): logit of default =
# -(CreditScore - 575) / 80 - (Income - 80000) / 60000 + debt_to_income / 10.
FROZEN_LINEAR = {"CreditScore": -1.0 / 80.0, "Income": -1.0 / 60000.0, "debt_to_income": 1.0 / 10.0}


def contributions(df: DataFrame, coefs: dict[str, float] | None = None, key: str = "app_id",
                  n: int = 3, means: dict[str, float] | None = None) -> DataFrame:
    """SC-6: per-row contributions coef * (x - mean) of a linear model; the
    ``n`` largest by |contribution| per row (ties by name), computed inside
    each row (array sort) -- no shuffle, no per-key window."""
    coefs = coefs or FROZEN_LINEAR
    x = df if "debt_to_income" in df.columns or "debt_to_income" not in coefs else \
        df.withColumn("debt_to_income", F.when(F.col("Income") > 0, F.col("LoanAmount") / F.col("Income")))
    if means is None:
        r = x.agg(*[F.avg(c).alias(c) for c in coefs]).first()
        means = {c: r[c] for c in coefs}
    items = F.array(*[F.struct(F.lit(c).alias("feature"),
                               (F.lit(w) * (F.col(c).cast("double") - F.lit(means[c]))).alias("contribution"))
                      for c, w in coefs.items()])

    def cmp(a, b):
        aa, bb = F.abs(a["contribution"]), F.abs(b["contribution"])
        return (F.when(aa > bb, -1).when(aa < bb, 1)
                .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0))
    top = F.slice(F.array_sort(items, cmp), 1, n)
    return x.select(key, F.posexplode(top).alias("pos", "c")) \
        .select(key, (F.col("pos") + 1).alias("rank"), "c.feature", "c.contribution")


def extra_outputs(df: DataFrame, score_col: str = "risk_score") -> DataFrame:
    """SC-7: approval probability (1 - risk) and the risk-based interest rate."""
    return price(df.withColumn("approval_probability", F.lit(1.0) - F.col(score_col)), score_col)
