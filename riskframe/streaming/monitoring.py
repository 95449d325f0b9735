"""ST-1..6: scoring and monitoring on Structured Streaming.

Each monitor is written once as a function of a DataFrame, so the same code
runs on a batch frame (checked against SQL) and on a stream (``readStream``
with a watermark bounding the state)."""

from __future__ import annotations

import math
import os
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import APPROVE, decision_expr
from ..session import ensure_checkpoint_dir


def event_time(df: DataFrame, col: str = "app_ts") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ); the session zone is UTC."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def score_stream(df: DataFrame, score_col: str = "risk_score", approve: float = 0.30,
                 reject: float = 0.70, model=None) -> DataFrame:
    """ST-1: per-row decision for a stream of applications (stateless); with a
    fitted model the score is computed first (frozen preparation + model)."""
    if model is not None:
        df = model.score(df, out=score_col)
    return df.withColumn("decision", decision_expr(score_col, approve, reject))


def decision_mix(df: DataFrame, ts: str = "app_ts", window: str = "7 days", watermark: str | None = None) -> DataFrame:
    """ST-2: count per tumbling window and decision. With ``watermark`` the
    aggregation state is dropped once the watermark passes a window."""
    d = df.withWatermark(ts, watermark) if watermark else df
    g = d.groupBy(F.window(ts, window).alias("w"), "decision").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "decision", "n")


def sliding_approval(df: DataFrame, ts: str = "app_ts", window: str = "7 days", slide: str = "1 day",
                     low: float = 0.5, high: float = 0.95, watermark: str | None = None) -> DataFrame:
    """ST-3: approval rate per sliding window and an alert when it leaves [low, high]."""
    d = df.withWatermark(ts, watermark) if watermark else df
    g = d.groupBy(F.window(ts, window, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == APPROVE).alias("approved"))
    rate = F.col("approved") / F.col("n")
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "approved",
                    rate.alias("approval_rate"), ((rate < F.lit(low)) | (rate > F.lit(high))).alias("alert"))


def drift_by_period(df: DataFrame, ts: str = "app_ts", score_col: str = "risk_score",
                    outcome: str = "defaulted", period: str = "month", threshold: float = 0.10) -> DataFrame:
    """ST-4 (batch form): actual default rate vs mean predicted score per
    period; alert when they differ by more than ``threshold``. Scores are
    summed as decimals of 12 places, so the mean doesn't depend on the order
    of the rows."""
    n = F.count(F.lit(1))
    known = F.count(outcome)
    g = df.groupBy(F.date_trunc(period, F.col(ts)).alias("period")).agg(
        n.alias("n"), F.try_divide(F.sum(F.col(outcome).cast("double")), known).alias("actual_default_rate"),
        F.try_divide(F.sum(F.col(score_col).cast("decimal(28,12)")).cast("double"), F.count(score_col)).alias("mean_predicted"))
    gap = F.abs(F.col("actual_default_rate") - F.col("mean_predicted"))
    return g.withColumn("gap", gap).withColumn("alert", gap > F.lit(threshold))


def drift_stream(decisions: DataFrame, outcomes: DataFrame, key: str = "app_id", ts: str = "app_ts",
                 outcome_ts: str = "outcome_ts", delay: str = "90 days", watermark: str = "30 days",
                 window: str = "30 days", score_col: str = "risk_score", outcome: str = "defaulted",
                 threshold: float = 0.10) -> DataFrame:
    """ST-4 (stream form): join scored applications to outcomes arriving up to
    ``delay`` later (stream-stream join, both sides watermarked so join state
    is bounded), then compare actual vs predicted per event-time window."""
    d = decisions.withWatermark(ts, watermark).alias("d")
    o = outcomes.withWatermark(outcome_ts, watermark).alias("o")
    j = d.join(o, F.expr(f"d.{key} = o.{key} AND o.{outcome_ts} >= d.{ts} "
                         f"AND o.{outcome_ts} <= d.{ts} + interval {delay}"))
    g = j.groupBy(F.window(F.col(f"d.{ts}"), window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(f"o.{outcome}").cast("double")).alias("actual_default_rate"),
        F.avg(F.col(f"d.{score_col}")).alias("mean_predicted"))
    gap = F.abs(F.col("actual_default_rate") - F.col("mean_predicted"))
    return g.select(F.col("w.start").alias("window_start"), "n", "actual_default_rate", "mean_predicted",
                    gap.alias("gap"), (gap > F.lit(threshold)).alias("alert"))


def portfolio_overview(df: DataFrame, ts: str = "app_ts", as_of: str | None = None) -> DataFrame:
    """ST-5: totals today / this week / all time relative to ``as_of`` (default:
    the latest event time in the data, so the result is reproducible)."""
    ref = F.lit(as_of).cast("timestamp") if as_of else None
    base = df if ref is not None else df.crossJoin(F.broadcast(df.agg(F.max(ts).alias("__asof"))))
    r = ref if ref is not None else F.col("__asof")
    day0 = F.date_trunc("day", r)
    today = F.col(ts) >= day0
    week = F.col(ts) >= day0 - F.expr("INTERVAL 6 DAYS")
    ok = F.col("decision") == APPROVE
    return base.agg(F.count(F.lit(1)).alias("total_all"), F.count_if(week).alias("total_week"),
                    F.count_if(today).alias("total_today"), F.count_if(ok).alias("approved_all"),
                    F.count_if(ok & week).alias("approved_week"), F.count_if(ok & today).alias("approved_today"))


def last_decisions(df: DataFrame, ts: str = "app_ts", key: str = "app_id", n: int = 10) -> DataFrame:
    """ST-5: the ``n`` most recent decisions (a top-k: partial top-k per task,
    one small merge)."""
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def audit_log(df: DataFrame, key: str = "app_id", ts: str = "app_ts", watermark: str | None = None) -> DataFrame:
    """ST-6: one audit row per application id (idempotent re-delivery). On a
    stream the de-duplication state is bounded by the watermark."""
    if watermark:
        return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])


# ---------------------------------------------------------------- stream runs
#: Rows of an arrival beyond which a stream's state takes one more partition.
STATE_ROWS = 100_000


def _cuts(df: DataFrame, ts: str, batches: int) -> tuple[list[int], int]:
    """Cut points (seconds) of about equal arrivals in event-time order, and
    the number of rows."""
    secs = F.col(ts).cast("long")
    r = df.agg(F.percentile_approx(secs, [i / batches for i in range(1, batches)], 1000).alias("c"),
               F.count(F.lit(1)).alias("n")).first()
    return sorted(set(r["c"] or [])), r["n"]


@contextmanager
def _state_partitions(spark: SparkSession, rows: int):
    """Streams started here keep their state in a partition per ``STATE_ROWS``
    of the ``rows`` of an arrival, one per core at least and as many as the
    session's shuffle partitions at most: every partition writes files for
    each store and batch, with or without rows."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    n = min(int(was), max(spark.sparkContext.defaultParallelism, math.ceil(rows / STATE_ROWS)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def _stage(df: DataFrame, ts: str, cuts: list[int], path: str) -> None:
    """One write of all arrivals, one folder each."""
    secs = F.col(ts).cast("long")
    arrival = sum((F.when(secs > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    df.withColumn("__arrival", arrival).write.partitionBy("__arrival").parquet(path)


def _arrive(spark: SparkSession, schema, staged: str, i: int, source: str) -> None:
    """Arrival ``i`` reaches the stream's folder (reads that arrival only)."""
    spark.read.schema(schema).parquet(f"{staged}/__arrival={i}").write.mode("append").parquet(source)


def _arrivals(df: DataFrame, n: int, staged: str) -> set[int]:
    """Which arrivals have rows (a folder listing)."""
    got = df.sparkSession.read.parquet(staged).select("__arrival").distinct().collect()
    return {r[0] for r in got if r[0] < n}


def replay(spark: SparkSession, df: DataFrame, build, name: str, ts: str = "app_ts", batches: int = 8,
           mode: str = "append", base: str | None = None, sink=None) -> DataFrame | None:
    """Feed ``df`` to a streaming plan as ``batches`` arrivals in event-time
    order and return the sink as a batch DataFrame.

    The source is read twice: for the cut points and for one write of all
    arrivals, a folder each. Arrival i then reaches the stream's source folder
    and the stream runs with ``trigger(availableNow=True)`` against one
    checkpoint. State, watermark and processed-file log carry over between
    runs, as for data arriving over time; a restart resumes from the checkpoint
    without duplicating output. With ``sink``, a ``foreachBatch`` function,
    output goes there and nothing is returned. Everything lives under the shared
    checkpoint folder. Rows without an event time come with the first arrival."""
    root = os.path.join(base or os.path.join(ensure_checkpoint_dir(spark), "streams"), name)
    staged, src, out, ck = (os.path.join(root, d) for d in ("staged", "source", "out", "checkpoint"))
    cuts, n = _cuts(df, ts, batches)
    _stage(df, ts, cuts, staged)
    for i in sorted(_arrivals(df, len(cuts) + 1, staged)):
        _arrive(spark, df.schema, staged, i, src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        w = build(stream).writeStream.option("checkpointLocation", ck).outputMode(mode).trigger(availableNow=True)
        with _state_partitions(spark, n // (len(cuts) + 1)):
            q = w.foreachBatch(sink).start() if sink else w.format("parquet").option("path", out).start()
            q.awaitTermination()
    return None if sink else spark.read.parquet(out)


def replay_join(spark: SparkSession, left: DataFrame, right: DataFrame, build, name: str,
                left_ts: str = "app_ts", right_ts: str = "outcome_ts", batches: int = 8,
                base: str | None = None) -> DataFrame:
    """``replay`` for two inputs (stream-stream joins): both sides arrive in
    event-time order, cut at the same fixed points of the left side's time."""
    root = os.path.join(base or os.path.join(ensure_checkpoint_dir(spark), "streams"), name)
    lsrc, rsrc, out, ck = (os.path.join(root, d) for d in ("left", "right", "out", "checkpoint"))
    cuts, n = _cuts(left, left_ts, batches)
    for df, ts, side in ((left, left_ts, "left-staged"), (right, right_ts, "right-staged")):
        _stage(df, ts, cuts, os.path.join(root, side))
    have = [_arrivals(df, len(cuts) + 1, os.path.join(root, side)) for df, side in ((left, "left-staged"), (right, "right-staged"))]
    for i in range(len(cuts) + 1):
        for df, side, src, own in ((left, "left-staged", lsrc, have[0]), (right, "right-staged", rsrc, have[1])):
            if i in own:
                _arrive(spark, df.schema, os.path.join(root, side), i, src)
            else:                       # the folder must exist for the stream to start
                df.sparkSession.createDataFrame([], df.schema).write.mode("append").parquet(src)
        ls = spark.readStream.schema(left.schema).parquet(lsrc)
        rs = spark.readStream.schema(right.schema).parquet(rsrc)
        w = (build(ls, rs).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
             .outputMode("append").trigger(availableNow=True))
        with _state_partitions(spark, n // (len(cuts) + 1)):
            w.start().awaitTermination()
    return spark.read.parquet(out)
