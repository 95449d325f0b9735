"""Registered scoring (SC-2..7) and monitoring (ST-*) queries on the frozen
``risk_score`` of the applications view, plus the stream runs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import scoring as SC
from ..session import cut_lineage, ensure_checkpoint_dir, utc_session
from ..sources import fixtures as X
from ..streaming import monitoring as M
from ..streaming import state as ST
from .catalog import Query, register

_DEC = ("CASE WHEN risk_score < 3e-1 THEN 'APPROVE' WHEN risk_score > 7e-1 THEN 'REJECT' ELSE 'REVIEW' END")


def _pct_sql(x: str, d: int) -> str:
    if d == 0:
        return f"CAST(CAST(round({x} * 100.0) AS BIGINT) AS VARCHAR) || '%'"
    s = 10 ** d
    v = f"CAST(round({x} * {100.0 * s}) AS BIGINT)"
    return f"CAST({v} // {s} AS VARCHAR) || '.' || lpad(CAST({v} % {s} AS VARCHAR), {d}, '0') || '%'"


def _explain_sql(d: int) -> str:
    r = _pct_sql("risk_score", d)
    return (f"CASE WHEN {_DEC} = 'APPROVE' THEN 'Risk score ' || {r} || ' is below approval threshold (30%)' "
            f"WHEN {_DEC} = 'REJECT' THEN 'Risk score ' || {r} || ' exceeds rejection threshold (70%)' "
            f"ELSE 'Risk score ' || {r} || ' requires manual review (between 30%-70%)' END")


register(Query(
    "decision_explanations",
    lambda spark, sf: SC.decide_and_explain(X.scored(spark, sf)).select("app_id", "decision", "explanation"),
    operators="SC-2", sql=f"SELECT app_id, {_DEC} AS decision, {_explain_sql(2)} AS explanation FROM scored"))

register(Query(
    "decision_explanations_ui",
    lambda spark, sf: SC.decide_and_explain(X.scored(spark, sf), decimals=1).select("app_id", "explanation"),
    operators="SC-2", sql=f"SELECT app_id, {_explain_sql(1)} AS explanation FROM scored"))

register(Query(
    "batch_statistics", lambda spark, sf: SC.batch_statistics(SC.decide_and_explain(X.scored(spark, sf))),
    operators="SC-3", floats=["mean_risk_score", "min_risk_score", "max_risk_score", "median_risk_score", "approval_rate"],
    sql=f"""SELECT count(*) AS total_applicants, avg(risk_score) AS mean_risk_score, min(risk_score) AS min_risk_score,
 max(risk_score) AS max_risk_score, count_if(d = 'APPROVE') AS n_approve, count_if(d = 'REVIEW') AS n_review,
 count_if(d = 'REJECT') AS n_reject, count_if(d = 'ERROR') AS n_error,
 quantile_cont(risk_score, 0.5) AS median_risk_score, count_if(d = 'APPROVE') / count(*) AS approval_rate
FROM (SELECT risk_score, {_DEC} AS d FROM scored) t"""))


def _routed(spark, sf):
    return SC.route_errors(X.applications_dirty(spark, sf)).select("app_id", "risk_score", "decision", "explanation")


_ERR = ("concat_ws('; ', " + ", ".join(
    [f"CASE WHEN {c} IS NULL THEN '{c} missing' END" for c in ["Age", "Income", "CreditScore", "LoanAmount",
                                                               "YearsExperience"]]
    + [f"CASE WHEN NOT ({c} BETWEEN {lo} AND {hi}) THEN '{c} out of range' END"
       for c, (lo, hi) in SC.RANGES.items()]) + ")")

register(Query(
    "error_routing", _routed, operators="SC-4", floats=["risk_score"],
    sql=f"""SELECT app_id, CASE WHEN err <> '' THEN NULL ELSE risk_score END AS risk_score,
 CASE WHEN err <> '' THEN 'ERROR' ELSE {_DEC} END AS decision,
 CASE WHEN err <> '' THEN err ELSE {_explain_sql(2)} END AS explanation
FROM (SELECT *, {_ERR} AS err FROM applications_dirty) t"""))

register(Query(
    "processing_counts", lambda spark, sf: SC.processing_counts(SC.route_errors(X.applications_dirty(spark, sf))),
    operators="SC-4",
    sql=f"""SELECT count(*) AS submitted, count_if(err = '') AS processed, count_if(err <> '') AS failed
FROM (SELECT {_ERR} AS err FROM applications_dirty) t"""))

register(Query(
    "feature_contributions", lambda spark, sf: SC.contributions(X.applications(spark, sf)),
    operators="SC-6", floats=["contribution"],
    ctes="""dx AS (SELECT *, CASE WHEN Income > 0 THEN LoanAmount / Income END AS debt_to_income FROM applications),
mu AS (SELECT avg(CreditScore) AS m_cs, avg(Income) AS m_in, avg(debt_to_income) AS m_dti FROM dx),
c AS (SELECT app_id, 'CreditScore' AS feature, (-1.0 / 80.0) * (CreditScore - m_cs) AS contribution FROM dx, mu
  UNION ALL SELECT app_id, 'Income', (-1.0 / 60000.0) * (Income - m_in) FROM dx, mu
  UNION ALL SELECT app_id, 'debt_to_income', (1.0 / 10.0) * (debt_to_income - m_dti) FROM dx, mu)""",
    sql="""SELECT app_id, rank, feature, contribution FROM (SELECT app_id, feature, contribution,
 CAST(row_number() OVER (PARTITION BY app_id ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank FROM c) t
WHERE rank <= 3"""))

register(Query(
    "extra_outputs", lambda spark, sf: SC.extra_outputs(X.scored(spark, sf))
    .select("app_id", "approval_probability", "risk_band", "interest_rate"),
    operators="SC-7", floats=["approval_probability", "interest_rate"],
    sql="""SELECT app_id, 1.0 - risk_score AS approval_probability, band AS risk_band,
 CASE band WHEN 'Low Risk' THEN 4.5 WHEN 'Moderate Risk' THEN 5.5 WHEN 'High Risk' THEN 7.5 END AS interest_rate
FROM (SELECT *, CASE WHEN risk_score < 25e-2 THEN 'Low Risk' WHEN risk_score < 5e-1 THEN 'Moderate Risk'
      WHEN risk_score < 75e-2 THEN 'High Risk' ELSE 'Very High Risk' END AS band FROM scored) t"""))


# ------------------------------------------------------------------ ST (batch forms)
def _decided(spark, sf):
    # batch forms stay on TIMESTAMP_NTZ: windows and formatting then do not
    # depend on the session time zone (streams cast for the watermark)
    return M.score_stream(X.scored(spark, sf))


_TS = "yyyy-MM-dd HH:mm:ss"


def _fmt(df, cols):
    return df.select(*[F.date_format(c, _TS).alias(c) if c in cols else F.col(c) for c in df.columns])


_DECIDED_CTE = f"decided AS (SELECT *, {_DEC} AS decision FROM scored)"

register(Query(
    "decision_mix_windows", lambda spark, sf: _fmt(M.decision_mix(_decided(spark, sf)), ["window_start", "window_end"]),
    operators="ST-2", ctes=_DECIDED_CTE,
    sql="""SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
 decision, count(*) AS n FROM (SELECT time_bucket(INTERVAL 7 DAY, app_ts, TIMESTAMP '1970-01-01 00:00:00') AS ws, decision
 FROM decided) t GROUP BY ALL"""))

register(Query(
    "sliding_approval", lambda spark, sf: _fmt(M.sliding_approval(_decided(spark, sf)), ["window_start", "window_end"]),
    operators="ST-3", floats=["approval_rate"], ctes=_DECIDED_CTE,
    sql="""SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
 count(*) AS n, count_if(decision = 'APPROVE') AS approved, count_if(decision = 'APPROVE') / count(*) AS approval_rate,
 count_if(decision = 'APPROVE') / count(*) < 0.5 OR count_if(decision = 'APPROVE') / count(*) > 0.95 AS alert
FROM (SELECT date_trunc('day', app_ts) - k * INTERVAL 1 DAY AS ws, decision FROM decided, range(7) r(k)) t GROUP BY ws"""))

register(Query(
    "drift_by_month", lambda spark, sf: _fmt(M.drift_by_period(_decided(spark, sf)), ["period"]),
    operators="ST-4", floats=["actual_default_rate", "mean_predicted", "gap"],
    sql="""SELECT strftime(date_trunc('month', app_ts), '%Y-%m-%d %H:%M:%S') AS period, count(*) AS n,
 sum(CAST(defaulted AS DOUBLE)) / count(*) AS actual_default_rate, ps / count(*) AS mean_predicted,
 abs(sum(CAST(defaulted AS DOUBLE)) / count(*) - ps / count(*)) AS gap,
 abs(sum(CAST(defaulted AS DOUBLE)) / count(*) - ps / count(*)) > 0.10 AS alert
FROM scored JOIN (SELECT date_trunc('month', app_ts) AS m, CAST(sum(CAST(risk_score AS DECIMAL(28,12))) AS DOUBLE) AS ps
  FROM scored GROUP BY 1) p ON m = date_trunc('month', app_ts) GROUP BY 1, ps"""))

register(Query(
    "portfolio_overview", lambda spark, sf: M.portfolio_overview(_decided(spark, sf)), operators="ST-5",
    ctes=_DECIDED_CTE + ", mx AS (SELECT date_trunc('day', max(app_ts)) AS d0 FROM decided)",
    sql="""SELECT count(*) AS total_all, count_if(app_ts >= d0 - INTERVAL 6 DAY) AS total_week,
 count_if(app_ts >= d0) AS total_today, count_if(decision = 'APPROVE') AS approved_all,
 count_if(decision = 'APPROVE' AND app_ts >= d0 - INTERVAL 6 DAY) AS approved_week,
 count_if(decision = 'APPROVE' AND app_ts >= d0) AS approved_today FROM decided, mx"""))

register(Query(
    "last_decisions", lambda spark, sf: _fmt(M.last_decisions(_decided(spark, sf)).select("app_id", "app_ts", "decision"),
                                             ["app_ts"]),
    operators="ST-5", ctes=_DECIDED_CTE,
    sql="""SELECT app_id, strftime(app_ts, '%Y-%m-%d %H:%M:%S') AS app_ts, decision FROM decided
ORDER BY decided.app_ts DESC, app_id DESC LIMIT 10"""))


# ------------------------------------------------------------------ ST (stream runs)
def _root(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")


def _stream_scoring(spark, sf):
    with utc_session(spark):
        return M.replay(spark, M.event_time(X.scored(spark, sf)),
                        lambda s: M.score_stream(s).select("app_id", "decision"), "scoring",
                        base=_root(spark, "scoring"))


register(Query(
    "stream_scoring", _stream_scoring, operators="ST-1",
    sql=f"SELECT app_id, {_DEC} AS decision FROM scored"))


def _stream_audit(spark, sf):
    with utc_session(spark):
        return M.replay(spark, M.event_time(X.applications_dup(spark, sf)),
                        lambda s: M.audit_log(s, watermark="1 day").select("app_id"), "audit",
                        base=_root(spark, "audit"))


register(Query(
    "stream_audit_log", _stream_audit, operators="ST-6",
    sql="SELECT DISTINCT app_id FROM applications_dup"))


def _stream_mix(spark, sf):
    # window strings are formatted inside the stream while the session zone is
    # UTC, so the sink holds zone-free text whatever the caller's zone is
    with utc_session(spark):
        return M.replay(spark, M.event_time(X.scored(spark, sf)),
                        lambda s: _fmt(M.decision_mix(M.score_stream(s), watermark="14 days"),
                                       ["window_start", "window_end"]),
                        "mix", base=_root(spark, "mix"))


register(Query(
    "stream_decision_mix", _stream_mix, operators="ST-2", ctes=_DECIDED_CTE,
    # append mode emits a window once the watermark (max event time - 14 days)
    # has passed its end; the final no-data batch applies the last watermark
    sql="""SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
 decision, count(*) AS n FROM (SELECT time_bucket(INTERVAL 7 DAY, app_ts, TIMESTAMP '1970-01-01 00:00:00') AS ws, decision
 FROM decided) t WHERE ws + INTERVAL 7 DAY <= (SELECT max(app_ts) FROM decided) - INTERVAL 14 DAY GROUP BY ALL"""))


def _stream_sliding(spark, sf):
    with utc_session(spark):
        return M.replay(spark, M.event_time(X.scored(spark, sf)),
                        lambda s: _fmt(M.sliding_approval(M.score_stream(s), watermark="14 days"),
                                       ["window_start", "window_end"]),
                        "sliding", base=_root(spark, "sliding"))


register(Query(
    "stream_sliding_approval", _stream_sliding, operators="ST-3", floats=["approval_rate"], ctes=_DECIDED_CTE,
    # as in stream_decision_mix: exactly the windows that the watermark has closed
    sql="""SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
 count(*) AS n, count_if(decision = 'APPROVE') AS approved, count_if(decision = 'APPROVE') / count(*) AS approval_rate,
 count_if(decision = 'APPROVE') / count(*) < 0.5 OR count_if(decision = 'APPROVE') / count(*) > 0.95 AS alert
FROM (SELECT date_trunc('day', app_ts) - k * INTERVAL 1 DAY AS ws, decision FROM decided, range(7) r(k)) t
WHERE ws + INTERVAL 7 DAY <= (SELECT max(app_ts) FROM decided) - INTERVAL 14 DAY GROUP BY ws"""))


def _outcomes(scored):
    """Outcomes become known 60 days after the application (fixed delay)."""
    return scored.select("app_id", (F.col("app_ts") + F.expr("INTERVAL 60 DAYS")).alias("outcome_ts"), "defaulted")


def _stream_drift(spark, sf):
    with utc_session(spark):
        sc = M.event_time(X.scored(spark, sf))
        dec = sc.select("app_id", "app_ts", "risk_score")
        return M.replay_join(spark, dec, _outcomes(sc),
                             lambda d, o: _fmt(M.drift_stream(d, o, window="30 days"), ["window_start"]),
                             "drift", base=_root(spark, "drift"))


register(Query(
    "stream_drift", _stream_drift, operators="ST-4", floats=["actual_default_rate", "mean_predicted", "gap"],
    # a window is emitted once no decision in it can meet an outcome any more:
    # the watermark (30 days after the latest decision) less the 90 days of delay
    sql="""SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, avg(CAST(defaulted AS DOUBLE)) AS actual_default_rate,
 avg(risk_score) AS mean_predicted, abs(avg(CAST(defaulted AS DOUBLE)) - avg(risk_score)) AS gap,
 abs(avg(CAST(defaulted AS DOUBLE)) - avg(risk_score)) > 0.10 AS alert
FROM (SELECT *, time_bucket(INTERVAL 30 DAY, app_ts, TIMESTAMP '1970-01-01 00:00:00') AS ws FROM scored) t
WHERE ws + INTERVAL 30 DAY <= (SELECT max(app_ts) FROM scored) - INTERVAL 120 DAY GROUP BY ws"""))


def _portfolio_rows(spark, sf, name):
    with utc_session(spark), ST.rocksdb_state(spark):
        return M.replay(spark, M.event_time(X.scored(spark, sf)), lambda s: ST.portfolio_stream(M.score_stream(s)), name,
                        batches=5, base=_root(spark, name))


register(Query(
    "stream_portfolio", lambda spark, sf: ST.portfolio_view(_portfolio_rows(spark, sf, "portfolio")), operators="ST-5",
    ctes=_DECIDED_CTE + ", mx AS (SELECT date_trunc('day', max(app_ts)) AS d0 FROM decided)",
    sql="""SELECT count(*) AS total_all, count_if(app_ts >= d0 - INTERVAL 6 DAY) AS total_week,
 count_if(app_ts >= d0) AS total_today, count_if(decision = 'APPROVE') AS approved_all,
 count_if(decision = 'APPROVE' AND app_ts >= d0 - INTERVAL 6 DAY) AS approved_week,
 count_if(decision = 'APPROVE' AND app_ts >= d0) AS approved_today FROM decided, mx"""))


def _stream_last(spark, sf):
    rows = ST.last_decisions_view(_portfolio_rows(spark, sf, "last"))
    return _fmt(rows.withColumnsRenamed({"id": "app_id", "at": "app_ts"}), ["app_ts"])


register(Query(
    "stream_last_decisions", _stream_last, operators="ST-5", ctes=_DECIDED_CTE,
    sql="""SELECT app_id, strftime(app_ts, '%Y-%m-%d %H:%M:%S') AS app_ts, decision FROM decided
ORDER BY decided.app_ts DESC, app_id DESC LIMIT 10"""))


def _stream_audit_once(spark, sf):
    """Every application, and a tenth of them again 400 days later, which no
    watermark of the stream would still know."""
    a = X.scored(spark, sf)
    again = a.where("app_id % 10 = 3").withColumn("app_ts", F.col("app_ts") + F.expr("INTERVAL 400 DAYS"))
    base = _root(spark, "audit-once")
    with utc_session(spark):
        M.replay(spark, M.event_time(a.unionByName(again)), lambda s: s.select("app_id", "app_ts", "risk_score"), "audit",
                 batches=4, base=base, sink=ST.audit_sink(f"{base}/log"))
        log = ST.read_audit(spark, f"{base}/log")
        return cut_lineage(_fmt(log, ["app_ts"]))


register(Query(
    "stream_audit_once", _stream_audit_once, operators="ST-6", floats=["risk_score"],
    sql="SELECT app_id, strftime(app_ts, '%Y-%m-%d %H:%M:%S') AS app_ts, risk_score FROM scored"))


def _stream_model(spark, sf):
    """ST-1 with a fitted model: frozen preparation and logistic regression
    score the stream, then the policy decides."""
    from . import model_check_queries as C

    m = C._two_fit(C._two_split(spark, sf))
    with utc_session(spark):
        return M.replay(spark, M.event_time(X.scored(spark, sf).drop("risk_score")),
                        lambda s: M.score_stream(s, model=m).select("app_id", "risk_score", "decision"), "model",
                        batches=3, base=_root(spark, "model"))


def _stream_model_sql() -> tuple[str, str]:
    from . import model_check_queries as C

    return C._FIT, f"""SELECT app_id, p AS risk_score, CASE WHEN p < 3e-1 THEN 'APPROVE' WHEN p > 7e-1 THEN 'REJECT' ELSE 'REVIEW' END AS decision
FROM (SELECT app_id, {C._PROB} AS p FROM sp, fit, st)"""


register(Query("stream_model_scoring", _stream_model, operators="ST-1 ML-4", floats=["risk_score"], digits={"risk_score": 4},
               ctes=_stream_model_sql()[0], sql=_stream_model_sql()[1]))
