"""Registered decisioning queries (DEC-*) over the ``applications`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import band_expr
from ..operators import decisions as D
from ..sources.fixtures import scored
from .catalog import Query, register

MONEY = {"expected_loss_approved": 2, "expected_loss_total": 2}
IMPACT_FLOATS = ["approval_rate", "default_rate_in_approved", "false_negative_rate",
                 "expected_loss_approved", "expected_loss_total"]

_DECISION_SQL = ("CASE WHEN risk_score < 3e-1 THEN 'APPROVE' WHEN risk_score > 7e-1 THEN 'REJECT' "
                 "ELSE 'REVIEW' END")


def _impact_sql(src: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}total_applicants, approved_count, reviewed_count, rejected_count,
 CASE WHEN total_applicants = 0 THEN 0.0 ELSE approved_count / total_applicants END AS approval_rate,
 approved_defaults,
 CASE WHEN approved_count = 0 THEN 0.0 ELSE approved_defaults / approved_count END AS default_rate_in_approved,
 CASE WHEN n_def = 0 THEN 0.0 ELSE approved_defaults / n_def END AS false_negative_rate,
 rejected_defaults, expected_loss_approved, expected_loss_total
FROM (SELECT {k}count(*) AS total_applicants,
  count_if(decision <> 'REJECT') AS approved_count,
  count_if(decision = 'REVIEW') AS reviewed_count,
  count_if(decision = 'REJECT') AS rejected_count,
  CAST(coalesce(sum(CASE WHEN decision <> 'REJECT' THEN defaulted END), 0) AS BIGINT) AS approved_defaults,
  CAST(coalesce(sum(CASE WHEN decision = 'REJECT' THEN defaulted END), 0) AS BIGINT) AS rejected_defaults,
  CAST(coalesce(sum(defaulted), 0) AS BIGINT) AS n_def,
  coalesce(sum(CASE WHEN decision <> 'REJECT' THEN risk_score * LoanAmount END), 0.0) AS expected_loss_approved,
  coalesce(sum(risk_score * LoanAmount), 0.0) AS expected_loss_total
 FROM {src}{g}) t"""


def _policy(spark, sf):
    return D.apply_policy(scored(spark, sf)).select("app_id", "decision", "decision_code")


register(Query(
    "decision_policy", _policy, operators="DEC-1",
    sql=f"""SELECT app_id, {_DECISION_SQL} AS decision,
 CAST(CASE WHEN risk_score < 3e-1 THEN 1 WHEN risk_score > 7e-1 THEN -1 ELSE 0 END AS INTEGER) AS decision_code
FROM scored"""))


def _impact(spark, sf):
    return D.business_impact(D.apply_policy(scored(spark, sf)))


register(Query(
    "business_impact", _impact, operators="DEC-2", floats=IMPACT_FLOATS, digits=MONEY,
    ctes=f"decided AS (SELECT *, {_DECISION_SQL} AS decision FROM scored)",
    sql=_impact_sql("decided")))


def _impact_by_city(spark, sf):
    return D.business_impact(D.apply_policy(scored(spark, sf)), by=["City"])


register(Query(
    "business_impact_by_city", _impact_by_city, operators="DEC-2", floats=IMPACT_FLOATS, digits=MONEY,
    ctes=f"decided AS (SELECT *, {_DECISION_SQL} AS decision FROM scored)",
    sql=_impact_sql("decided", "City")))


def _bands(spark, sf):
    s = scored(spark, sf)
    return s.select("app_id", *[band_expr("risk_score", p).alias(f"band_{p}")
                                for p in ["predictor", "single", "dashboard", "segments", "policy"]])


register(Query(
    "risk_bands", _bands, operators="DEC-3",
    sql="""SELECT app_id,
 CASE WHEN risk_score > 0e0 AND risk_score <= 3e-1 THEN 'Low Risk'
      WHEN risk_score > 3e-1 AND risk_score <= 7e-1 THEN 'Medium Risk'
      WHEN risk_score > 7e-1 AND risk_score <= 1e0 THEN 'High Risk' END AS band_predictor,
 CASE WHEN risk_score < 3e-1 THEN 'Low Risk' WHEN risk_score > 7e-1 THEN 'High Risk'
      ELSE 'Medium Risk' END AS band_single,
 CASE WHEN risk_score < 33e-2 THEN 'Low Risk' WHEN risk_score < 67e-2 THEN 'Medium Risk'
      ELSE 'High Risk' END AS band_dashboard,
 CASE WHEN risk_score < 2e-1 THEN 'Very Low Risk' WHEN risk_score < 4e-1 THEN 'Low Risk'
      WHEN risk_score < 6e-1 THEN 'Medium Risk' WHEN risk_score < 8e-1 THEN 'High Risk'
      ELSE 'Very High Risk' END AS band_segments,
 CASE WHEN risk_score < 25e-2 THEN 'Low Risk' WHEN risk_score < 5e-1 THEN 'Moderate Risk'
      WHEN risk_score < 75e-2 THEN 'High Risk' ELSE 'Very High Risk' END AS band_policy
FROM scored"""))

_SEGMENT_SQL = ("CASE WHEN risk_score < 2e-1 THEN 'Very Low Risk' WHEN risk_score < 4e-1 THEN 'Low Risk' "
                "WHEN risk_score < 6e-1 THEN 'Medium Risk' WHEN risk_score < 8e-1 THEN 'High Risk' "
                "ELSE 'Very High Risk' END")

register(Query(
    "segment_stats", lambda spark, sf: D.segment_stats(scored(spark, sf)), operators="DEC-4",
    floats=["mean_score", "min_score", "max_score", "actual_default_rate"],
    sql=f"""SELECT {_SEGMENT_SQL} AS risk_segment, count(*) AS count, avg(risk_score) AS mean_score,
 min(risk_score) AS min_score, max(risk_score) AS max_score,
 avg(CAST(defaulted AS DOUBLE)) AS actual_default_rate
FROM scored GROUP BY 1"""))

_SWEEP_CTES = """th AS (SELECT CAST(i AS INTEGER) AS i, 1e-1 + 5e-2 * i AS t FROM range(16) r(i)),
pairs AS (SELECT CAST(row_number() OVER (ORDER BY a.i, b.i) - 1 AS INTEGER) AS pair_id,
  a.t AS approve_threshold, b.t AS reject_threshold FROM th a JOIN th b ON a.i < b.i),
swept AS (SELECT p.pair_id, p.approve_threshold, p.reject_threshold, s.defaulted, s.risk_score, s.LoanAmount,
  CASE WHEN s.risk_score < p.approve_threshold THEN 'APPROVE'
       WHEN s.risk_score > p.reject_threshold THEN 'REJECT' ELSE 'REVIEW' END AS decision
  FROM pairs p CROSS JOIN scored s),
sweep AS (""" + _impact_sql("swept", "pair_id, approve_threshold, reject_threshold") + ")"

SWEEP_FLOATS = ["approve_threshold", "reject_threshold"] + IMPACT_FLOATS

register(Query(
    "threshold_sweep", lambda spark, sf: D.threshold_sweep(scored(spark, sf)), operators="DEC-5",
    floats=SWEEP_FLOATS, digits=MONEY, ctes=_SWEEP_CTES, sql="SELECT * FROM sweep"))

register(Query(
    "best_threshold_approval", lambda spark, sf: D.best_thresholds(D.threshold_sweep(scored(spark, sf)),
                                                                   "approval_rate"),
    operators="DEC-6", floats=SWEEP_FLOATS, digits=MONEY, ctes=_SWEEP_CTES,
    sql="SELECT * FROM sweep ORDER BY approval_rate DESC, pair_id LIMIT 1"))

register(Query(
    "best_threshold_default_rate", lambda spark, sf: D.best_thresholds(D.threshold_sweep(scored(spark, sf)),
                                                                       "default_rate"),
    operators="DEC-6", floats=SWEEP_FLOATS, digits=MONEY, ctes=_SWEEP_CTES,
    sql="SELECT * FROM sweep ORDER BY default_rate_in_approved, pair_id LIMIT 1"))

register(Query(
    "best_threshold_expected_loss", lambda spark, sf: D.best_thresholds(D.threshold_sweep(scored(spark, sf)),
                                                                        "expected_loss"),
    operators="DEC-6", floats=SWEEP_FLOATS, digits=MONEY, ctes=_SWEEP_CTES,
    sql="SELECT * FROM sweep ORDER BY expected_loss_approved, pair_id LIMIT 1"))

register(Query(
    "constrained_threshold", lambda spark, sf: D.constrained_best(D.threshold_sweep(scored(spark, sf))),
    operators="DEC-7", floats=SWEEP_FLOATS, digits=MONEY, ctes=_SWEEP_CTES,
    sql="""SELECT * FROM sweep WHERE default_rate_in_approved <= 2e-1 AND approval_rate >= 5e-1
ORDER BY approval_rate DESC, default_rate_in_approved, pair_id LIMIT 1"""))

register(Query(
    "pareto_thresholds", lambda spark, sf: D.pareto_frontier(D.threshold_sweep(scored(spark, sf))),
    operators="DEC-7", floats=SWEEP_FLOATS, digits=MONEY, ctes=_SWEEP_CTES,
    sql="""SELECT * EXCLUDE (bb) FROM (SELECT *, min(default_rate_in_approved) OVER (
  ORDER BY approval_rate DESC, default_rate_in_approved, pair_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb FROM sweep) t
WHERE bb IS NULL OR default_rate_in_approved < bb"""))

_TRADEOFF_CTES = """pc AS (SELECT quantile_cont(risk_score, 1e-1) AS p10, quantile_cont(risk_score, 75e-2) AS p75,
  quantile_cont(risk_score, 9e-1) AS p90, min(risk_score) AS mn FROM scored),
steps AS (SELECT CAST(k AS INTEGER) AS pair_id,
  CASE WHEN k = 24 THEN p75 ELSE mn + k * ((p75 - mn) / 24) END AS approve_threshold, p10, p75, p90
  FROM pc, range(25) r(k)),
pairs AS (SELECT pair_id, approve_threshold,
  greatest(p90, approve_threshold + (p75 - p10) * 1e-1) AS reject_threshold FROM steps),
swept AS (SELECT p.pair_id, p.approve_threshold, p.reject_threshold, s.defaulted, s.risk_score, s.LoanAmount,
  CASE WHEN s.risk_score < p.approve_threshold THEN 'APPROVE'
       WHEN s.risk_score > p.reject_threshold THEN 'REJECT' ELSE 'REVIEW' END AS decision
  FROM pairs p CROSS JOIN scored s)"""

register(Query(
    "tradeoff_curve", lambda spark, sf: D.tradeoff_curve(scored(spark, sf)), operators="DEC-8",
    floats=SWEEP_FLOATS, digits=MONEY,
    ctes=_TRADEOFF_CTES,
    sql=_impact_sql("swept", "pair_id, approve_threshold, reject_threshold")))


def _error_rates(spark, sf):
    return D.error_rates(D.apply_policy(scored(spark, sf)))


register(Query(
    "decision_error_rates", _error_rates, operators="DEC-9",
    floats=["false_positive_rate", "rejection_precision", "rejection_recall"],
    ctes=f"decided AS (SELECT *, {_DECISION_SQL} AS decision FROM scored)",
    sql="""SELECT good_rejected, bad_rejected,
 CASE WHEN goods = 0 THEN 0.0 ELSE good_rejected / goods END AS false_positive_rate,
 CASE WHEN rejected = 0 THEN 0.0 ELSE bad_rejected / rejected END AS rejection_precision,
 CASE WHEN bads = 0 THEN 0.0 ELSE bad_rejected / bads END AS rejection_recall
FROM (SELECT count_if(decision = 'REJECT' AND defaulted = 0) AS good_rejected,
  count_if(defaulted = 0) AS goods, count_if(decision = 'REJECT' AND defaulted = 1) AS bad_rejected,
  count_if(decision = 'REJECT') AS rejected, count_if(defaulted = 1) AS bads FROM decided) t"""))


def _pricing(spark, sf):
    return D.price(scored(spark, sf)).select("app_id", "risk_band", "interest_rate", "segment_action")


register(Query(
    "risk_pricing", _pricing, operators="DEC-10", floats=["interest_rate"],
    sql="""SELECT app_id, band AS risk_band,
 CASE band WHEN 'Low Risk' THEN 4.5e0 WHEN 'Moderate Risk' THEN 5.5e0 WHEN 'High Risk' THEN 7.5e0 END
   AS interest_rate,
 CASE band WHEN 'Low Risk' THEN 'auto_approve' WHEN 'Moderate Risk' THEN 'manual_review'
   WHEN 'High Risk' THEN 'conditional' ELSE 'auto_reject' END AS segment_action
FROM (SELECT app_id, CASE WHEN risk_score < 25e-2 THEN 'Low Risk' WHEN risk_score < 5e-1 THEN 'Moderate Risk'
      WHEN risk_score < 75e-2 THEN 'High Risk' ELSE 'Very High Risk' END AS band FROM scored) t"""))


def _size_policy(spark, sf):
    return D.size_aware_policy(scored(spark, sf)).select("app_id", "size_band", "decision", "approved_amount")


def _dec(a, r):
    return (f"CASE WHEN risk_score < {a!r} THEN 'APPROVE' WHEN risk_score > {r!r} THEN 'REJECT' "
            "ELSE 'REVIEW' END")


register(Query(
    "size_aware_policy", _size_policy, operators="DEC-11", floats=["approved_amount"],
    sql=f"""SELECT app_id, size_band,
 CASE size_band WHEN 'small' THEN {_dec(0.40, 0.75)} WHEN 'large' THEN {_dec(0.25, 0.65)}
   ELSE {_dec(0.30, 0.70)} END AS decision,
 CASE WHEN risk_score > 5e-1 THEN least(LoanAmount, 1e5) ELSE LoanAmount END AS approved_amount
FROM (SELECT *, CASE WHEN LoanAmount < 1e5 THEN 'small' WHEN LoanAmount > 3e5 THEN 'large'
  ELSE 'medium' END AS size_band FROM scored) t"""))


def _fairness(spark, sf):
    return D.fairness_audit(D.apply_policy(scored(spark, sf)), ["Gender", "City", "Education"])


register(Query(
    "fairness_audit", _fairness, operators="DEC-13", floats=["approval_rate", "ratio_to_max"],
    ctes=f"decided AS (SELECT *, {_DECISION_SQL} AS decision FROM scored)",
    sql="""SELECT attribute, group_value, applicants, approved, approval_rate,
 CASE WHEN max(approval_rate) OVER (PARTITION BY attribute) = 0 THEN 0.0
      ELSE approval_rate / max(approval_rate) OVER (PARTITION BY attribute) END AS ratio_to_max
FROM (SELECT attribute, group_value, count(*) AS applicants,
  CAST(sum(a) AS BIGINT) AS approved, sum(a) / count(*) AS approval_rate
 FROM (SELECT 'Gender' AS attribute, Gender AS group_value, CAST(decision = 'APPROVE' AS BIGINT) AS a FROM decided
       UNION ALL SELECT 'City', City, CAST(decision = 'APPROVE' AS BIGINT) FROM decided
       UNION ALL SELECT 'Education', Education, CAST(decision = 'APPROVE' AS BIGINT) FROM decided) u
 GROUP BY attribute, group_value) g"""))
