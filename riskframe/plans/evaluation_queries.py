"""Registered evaluation queries (EV-*): ``risk_score`` as the predicted
probability of ``defaulted``."""

from __future__ import annotations

import sys

from ..operators import evaluation as V
from ..sources.fixtures import scored
from .catalog import Query, register
from .sql_fits import newton_sql

EPS = repr(sys.float_info.epsilon)

_CONF = """count_if(risk_score >= {t} AND defaulted = 1) AS tp, count_if(risk_score < {t} AND defaulted = 0) AS tn,
 count_if(risk_score >= {t} AND defaulted = 0) AS fp, count_if(risk_score < {t} AND defaulted = 1) AS fn"""


def _rates(src: str, extra: str = "") -> str:
    return f"""SELECT *, CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + tn + fp + fn) END AS accuracy,
 CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
 CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
 CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1,
 CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS specificity,
 CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn) END AS npv,
 CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0 ELSE
  (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc{extra}
FROM {src}"""


RATE_FLOATS = ["accuracy", "precision", "recall", "f1", "specificity", "npv", "mcc"]

register(Query(
    "confusion_metrics", lambda spark, sf: V.confusion(scored(spark, sf)), operators="EV-1 EV-2 EV-3",
    floats=RATE_FLOATS + ["threshold"],
    sql=_rates(f"(SELECT {_CONF.format(t='5e-1')} FROM scored) c", ", 0.5 AS threshold")))

register(Query(
    "log_loss", lambda spark, sf: V.log_loss(scored(spark, sf)), operators="EV-4", floats=["log_loss"],
    sql=f"""SELECT -avg(defaulted * ln(p) + (1 - defaulted) * ln(1 - p)) AS log_loss
FROM (SELECT defaulted, least(greatest(risk_score, {EPS}), 1 - {EPS}) AS p FROM scored) t"""))

_CUM = """g AS (SELECT risk_score AS v, CAST(sum(defaulted) AS BIGINT) AS pos, CAST(count(*) - sum(defaulted) AS BIGINT) AS neg
  FROM scored WHERE risk_score IS NOT NULL GROUP BY risk_score),
c AS (SELECT v, pos, neg, sum(pos) OVER (ORDER BY v DESC) AS tp, sum(neg) OVER (ORDER BY v DESC) AS fp,
  sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g)"""

_AUC = """(sum(CASE WHEN defaulted = 1 THEN r ELSE 0 END) - count_if(defaulted = 1) * (count_if(defaulted = 1) + 1) / 2.0)
 / (CAST(count_if(defaulted = 1) AS DOUBLE) * count_if(defaulted = 0))"""
_RANKED = """(SELECT defaulted, (rank() OVER (ORDER BY risk_score) + rank() OVER (ORDER BY risk_score)
  + count(*) OVER (PARTITION BY risk_score) - 1) / 2.0 AS r FROM scored) rk"""
_PRAUC = """sum((tp - (tp - pos)) / P * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg = 0 THEN 1.0
  ELSE (tp - pos) / (tp - pos + fp - neg) END) / 2.0)"""

register(Query(
    "ranking_metrics", lambda spark, sf: V.ranking_metrics(scored(spark, sf)), operators="EV-5 EV-6 EV-12",
    floats=["roc_auc", "pr_auc", "ks"], ctes=_CUM,
    sql=f"""SELECT (SELECT {_AUC} FROM {_RANKED}) AS roc_auc, {_PRAUC} AS pr_auc,
 max(abs(tp / P - fp / N)) AS ks FROM c"""))

register(Query(
    "roc_curve", lambda spark, sf: V.roc_curve(scored(spark, sf)), operators="EV-7",
    floats=["threshold", "tpr", "fpr"], ctes=_CUM,
    sql="SELECT v AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp / P AS tpr, fp / N AS fpr FROM c"))

register(Query(
    "pr_curve", lambda spark, sf: V.pr_curve(scored(spark, sf)), operators="EV-8",
    floats=["threshold", "precision", "recall"], ctes=_CUM,
    sql="SELECT v AS threshold, tp / (tp + fp) AS precision, tp / P AS recall FROM c WHERE tp - pos < P"))

_BIN = " + ".join(f"CASE WHEN risk_score > {e!r} THEN 1 ELSE 0 END" for e in V.CAL_EDGES)
register(Query(
    "calibration_curve", lambda spark, sf: V.calibration_curve(scored(spark, sf)), operators="EV-9",
    floats=["prob_true", "prob_pred"],
    sql=f"""SELECT CAST({_BIN} AS INTEGER) AS bin, count(*) AS count, avg(CAST(defaulted AS DOUBLE)) AS prob_true,
 avg(risk_score) AS prob_pred FROM scored WHERE risk_score IS NOT NULL GROUP BY 1"""))

register(Query(
    "calibration_errors", lambda spark, sf: V.calibration_errors(scored(spark, sf)), operators="EV-11",
    floats=["brier", "ece", "mce"],
    ctes=f"""cal AS (SELECT {_BIN} AS bin, count(*) AS count, avg(CAST(defaulted AS DOUBLE)) AS prob_true,
 avg(risk_score) AS prob_pred FROM scored WHERE risk_score IS NOT NULL GROUP BY 1)""",
    sql="""SELECT (SELECT avg(pow(risk_score - defaulted, 2)) FROM scored WHERE risk_score IS NOT NULL) AS brier,
 sum(count * abs(prob_true - prob_pred)) / sum(count) AS ece, max(abs(prob_true - prob_pred)) AS mce FROM cal"""))

register(Query(
    "threshold_metrics", lambda spark, sf: V.threshold_metrics(scored(spark, sf)), operators="EV-10",
    floats=RATE_FLOATS + ["threshold"],
    sql=_rates(f"""(SELECT t AS threshold, CAST(count_if(risk_score >= t AND defaulted = 1) AS BIGINT) AS tp,
 CAST(count_if(risk_score < t AND defaulted = 0) AS BIGINT) AS tn, CAST(count_if(risk_score >= t AND defaulted = 0) AS BIGINT) AS fp,
 CAST(count_if(risk_score < t AND defaulted = 1) AS BIGINT) AS fn
 FROM scored, (VALUES (3e-1), (5e-1), (7e-1)) v(t) GROUP BY t) c""")))

_DEC = ", ".join(repr(float(x)) for x in __import__("numpy").linspace(0, 1, 11))
register(Query(
    "lift_table", lambda spark, sf: V.lift_table(scored(spark, sf)), operators="EV-13",
    floats=["default_rate", "lift"],
    ctes=f"""ed AS (SELECT DISTINCT unnest(quantile_cont(risk_score, [{_DEC}])) AS e FROM scored),
ext AS (SELECT min(e) AS e0, max(e) AS e1 FROM ed),
b AS (SELECT CAST(CASE WHEN risk_score < e0 OR risk_score > e1 THEN NULL
  ELSE greatest((SELECT count(*) FROM ed WHERE e < risk_score), 1) - 1 END AS INTEGER) AS decile, defaulted FROM scored, ext),
g AS (SELECT decile, count(*) AS count, CAST(sum(defaulted) AS BIGINT) AS defaults FROM b GROUP BY decile)""",
    sql="""SELECT decile, count, defaults, defaults / count AS default_rate,
 defaults / count / (SELECT sum(defaults) / sum(count) FROM g) AS lift FROM g"""))


def _platt(spark, sf):
    s = scored(spark, sf)
    m = V.platt_scaling(s)
    return V.platt_transform(m, s).select("app_id", "risk_score", "calibrated_score")


register(Query(
    "platt_scaling", _platt, operators="EV-14", floats=["risk_score", "calibrated_score"], digits={"calibrated_score": 4},
    # one feature: the second is 0 for every row and has a ridge term of its own
    ctes="""pl AS MATERIALIZED (SELECT app_id, risk_score, ln(p / (1 - p)) AS z1, 0e0 AS z2, CAST(defaulted AS DOUBLE) AS y, 1e0 AS w, 0 AS g,
  0e0 AS r1, 1e0 AS r2 FROM (SELECT *, least(greatest(risk_score, 1e-12), 1 - 1e-12) AS p FROM scored)),
""" + newton_sql("pl", "fit", steps=14),
    sql="SELECT app_id, risk_score, 1 / (1 + exp(-(a + b1 * z1))) AS calibrated_score FROM pl, fit"))

register(Query(
    "evaluation_report", lambda spark, sf: V.evaluation_report(scored(spark, sf)), operators="EV-15",
    floats=RATE_FLOATS + ["threshold", "log_loss", "roc_auc", "pr_auc"], ctes=_CUM,
    sql=_rates(f"""(SELECT {_CONF.format(t='5e-1')},
 -avg(defaulted * ln(least(greatest(risk_score, {EPS}), 1 - {EPS})) + (1 - defaulted) * ln(1 - least(greatest(risk_score, {EPS}), 1 - {EPS}))) AS log_loss
 FROM scored) base""", f""", (SELECT {_AUC} FROM {_RANKED}) AS roc_auc, (SELECT {_PRAUC} FROM c) AS pr_auc, 0.5 AS threshold""")))
