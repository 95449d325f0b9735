import os
import tempfile

from pyspark.sql import functions as F

from riskframe.sources import fixtures as X
from riskframe.streaming import monitoring as M


def test_stream_equals_batch_for_closed_windows(spark, sf):
    base = tempfile.mkdtemp(prefix="riskframe-stream-")
    scored = M.event_time(X.scored(spark, sf))
    batch = {(r["window_start"], r["decision"]): r["n"] for r in M.decision_mix(M.score_stream(scored)).collect()}
    out = M.replay(spark, scored, lambda s: M.decision_mix(M.score_stream(s), watermark="14 days"), "mix", base=base)
    got = {(r["window_start"], r["decision"]): r["n"] for r in out.collect()}
    assert got and len(got) < len(batch)           # append mode holds back windows after the watermark
    for k, v in got.items():
        assert batch[k] == v                        # every emitted window is final and exact


def test_stream_audit_dedupes(spark, sf):
    base = tempfile.mkdtemp(prefix="riskframe-audit-")
    dup = M.event_time(X.applications_dup(spark, sf))
    out = M.replay(spark, dup, lambda s: M.audit_log(s, watermark="1 day").select("app_id"), "audit", base=base)
    assert out.count() == dup.select("app_id").distinct().count()


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["total_applicants"] > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100


def test_stream_drift_join_matches_batch_for_closed_windows(spark, sf):
    base = tempfile.mkdtemp(prefix="riskframe-drift-")
    sc = M.event_time(X.scored(spark, sf))
    dec = sc.select("app_id", "app_ts", "risk_score")
    outc = sc.select("app_id", (F.col("app_ts") + F.expr("INTERVAL 60 DAYS")).alias("outcome_ts"), "defaulted")
    out = M.replay_join(spark, dec, outc, lambda d, o: M.drift_stream(d, o, window="30 days"), "drift", base=base)
    got = {r["window_start"]: (r["n"], r["actual_default_rate"]) for r in out.collect()}
    batch = {r["ws"]: (r["n"], r["adr"]) for r in sc.groupBy(F.window("app_ts", "30 days").start.alias("ws")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("defaulted").cast("double")).alias("adr")).collect()}
    assert got
    for k, (n, adr) in got.items():
        assert batch[k][0] == n and abs(batch[k][1] - adr) < 1e-12


def test_state_partitions_follow_the_rows_of_an_arrival(spark, monkeypatch):
    """a small arrival's join state has no more partitions than cores, a
    larger one's no more than the session's; the session's number comes back."""
    was, cores = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext.defaultParallelism
    rows = spark.range(40).selectExpr("id AS app_id", "timestamp_seconds(id * 1000000) AS app_ts", "id / 40D AS risk_score")
    outc = rows.selectExpr("app_id", "app_ts + INTERVAL 60 DAYS AS outcome_ts", "CAST(app_id % 2 AS INT) AS defaulted")
    spark.conf.set("spark.sql.shuffle.partitions", str(3 * cores))
    try:
        got = []
        for per in (100_000, 1):
            monkeypatch.setattr(M, "STATE_ROWS", per)
            base = tempfile.mkdtemp(prefix="riskframe-state-")
            out = M.replay_join(spark, rows, outc, lambda d, o: M.drift_stream(d, o, window="30 days"), "drift", batches=2, base=base)
            state = os.path.join(base, "drift", "checkpoint", "state", "0")
            got.append((sum(p.isdigit() for p in os.listdir(state)), sorted(map(str, out.collect()))))
            assert spark.conf.get("spark.sql.shuffle.partitions") == str(3 * cores)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0][0] == cores and got[1][0] == min(3 * cores, max(cores, 20))
    assert got[0][1] == got[1][1] and got[0][1]
