"""ST-5 and ST-6 with state of their own: stream = batch, restarts, late
duplicates, replayed batches; ST-1 with a model."""
import pytest
from pyspark.sql import functions as F
from riskframe.operators import training as T
from riskframe.session import utc_session
from riskframe.sources import fixtures as X
from riskframe.streaming import monitoring as M
from riskframe.streaming import state as ST

SCHEMA = "app_id long, app_ts timestamp, risk_score double"


def rows(spark, items):
    return spark.createDataFrame([(i, s, r) for i, s, r in items], "app_id long, s string, risk_score double") \
        .select("app_id", F.to_timestamp("s").alias("app_ts"), "risk_score")


def run(spark, src, base, build, **sink):
    """One start of the query: what arrived since the last one is processed."""
    w = build(spark.readStream.schema(SCHEMA).parquet(src)).writeStream.option("checkpointLocation", f"{base}/checkpoint") \
        .outputMode("append").trigger(availableNow=True)
    q = w.foreachBatch(sink["sink"]).start() if sink else w.format("parquet").option("path", f"{base}/out").start()
    q.awaitTermination()


def test_portfolio_stream_equals_batch_after_every_restart(spark, tmp_path):
    """Days roll out of the week by timers too: after January nothing arrives
    for some shards."""
    base, src = str(tmp_path), str(tmp_path / "source")
    parts = [[(i, f"2024-01-{1 + i % 9:02d} {i % 24:02d}:00:00", (i % 10) / 10) for i in range(60)],
             [(100 + i, f"2024-01-{8 + i % 5:02d} 0{i % 10}:30:00", (i % 7) / 7) for i in range(25)],
             [(200, "2024-02-20 10:00:00", 0.1), (201, "2024-02-20 11:00:00", 0.9), (202, "2024-02-26 23:59:59", 0.2)]]
    seen = []
    with utc_session(spark), ST.rocksdb_state(spark):
        for part in parts:
            seen += part
            rows(spark, part).coalesce(1).write.mode("append").parquet(src)
            run(spark, src, base, lambda s: ST.portfolio_stream(M.score_stream(s), shards=3, keep=5, watermark="30 days"))
            out = spark.read.parquet(f"{base}/out")
            batch = M.score_stream(rows(spark, seen))
            assert ST.portfolio_view(out).first() == M.portfolio_overview(batch).first()
            want = [(r.app_id, r.decision) for r in M.last_decisions(batch, n=5).collect()]
            assert [(r.id, r.decision) for r in ST.last_decisions_view(out, 5).collect()] == want
        days = out.join(out.groupBy("shard").agg(F.max("version").alias("version")), ["shard", "version"]).where("kind = 'day'")
        assert days.groupBy("shard").count().agg(F.max("count")).first()[0] <= 7
    assert spark.conf.get(ST.rocksdb_state.KEY, None) != ST.rocksdb_state.ROCKS


def test_audit_keeps_first_delivery_beyond_the_watermark(spark, tmp_path):
    base, src = str(tmp_path), str(tmp_path / "source")
    sink = ST.audit_sink(f"{base}/log", buckets=4)
    parts = [[(1, "2024-01-01 00:00:00", .1), (2, "2024-01-01 01:00:00", .2), (2, "2024-01-01 00:30:00", .3)],
             [(1, "2026-06-01 00:00:00", .9), (3, "2026-06-01 00:00:00", .4)],       # long after any watermark
             [(2, "2024-01-01 00:00:00", .8), (None, "2026-06-02 00:00:00", .5), (None, "2026-06-01 00:00:00", .6)],
             [(3, "2020-01-01 00:00:00", .7)]]
    with utc_session(spark):
        for part in parts:
            rows(spark, part).coalesce(1).write.mode("append").parquet(src)
            run(spark, src, base, lambda s: s, sink=sink)
        got = sorted(((r.app_id, r.risk_score) for r in ST.read_audit(spark, f"{base}/log").collect()), key=str)
    assert got == [(1, .1), (2, .3), (3, .4), (None, .6)]


def test_replayed_batch_leaves_one_row(spark, tmp_path):
    """The first try of a batch dies after it has written its folder; the
    restarted query gets the same batch again."""
    base, src = str(tmp_path), str(tmp_path / "source")
    sink, calls = ST.audit_sink(f"{base}/log", buckets=2), []

    def dies_once(batch, number):
        sink(batch, number)
        calls.append(number)
        if calls.count(1) == 1 and number == 1:
            raise RuntimeError("lost")

    with utc_session(spark):
        rows(spark, [(i, "2024-01-01 00:00:00", .1) for i in range(20)]).coalesce(1).write.mode("append").parquet(src)
        run(spark, src, base, lambda s: s, sink=dies_once)
        rows(spark, [(i, "2024-01-02 00:00:00", .2) for i in range(10, 30)]).coalesce(1).write.mode("append").parquet(src)
        with pytest.raises(Exception, match="lost"):
            run(spark, src, base, lambda s: s, sink=dies_once)
        run(spark, src, base, lambda s: s, sink=dies_once)
        assert calls == [0, 1, 1]
        got = sorted((r.app_id, r.risk_score) for r in ST.read_audit(spark, f"{base}/log").collect())
    assert got == [(i, .1 if i < 20 else .2) for i in range(30)]


def test_stream_scored_by_a_model_equals_batch(spark, sf, tmp_path):
    d = M.event_time(X.scored(spark, sf)).drop("risk_score")
    m = T.fit_model(d.where("app_id % 4 > 0"), "logistic_regression", ["CreditScore", "Income"], ["Gender"])
    with utc_session(spark):
        out = M.replay(spark, d, lambda s: M.score_stream(s, model=m).select("app_id", "risk_score", "decision"), "m",
                       batches=2, base=str(tmp_path))
        got = {r.app_id: (round(r.risk_score, 9), r.decision) for r in out.collect()}
    want = {r.app_id: (round(r.risk_score, 9), r.decision) for r in M.score_stream(d, model=m).collect()}
    assert got == want and len({v[1] for v in got.values()}) == 3
