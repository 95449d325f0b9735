"""ST-5 and ST-6 with state of their own.

* ``portfolio_stream`` keeps running totals, the counts of the last seven days
  and the last decisions as keyed state with event-time timers. Applications
  are dealt to shards by their id, so no task holds the whole portfolio; a
  shard's state is of fixed size. ``portfolio_view`` adds up the shards' latest
  rows.
* ``audit_sink`` writes a micro-batch so that every id is kept once, however
  late a duplicate comes and however often a batch is replayed."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import APPROVE

DAY = 86_400
WEEK = 7
_ROWS = "shard int, version long, kind string, day long, n long, approved long, id long, second long, decision string"


class Portfolio(StatefulProcessor):
    """State of a shard: ``totals`` (rows, approved rows, last event second,
    version of the rows sent), ``days`` (day -> rows, approved) of the last
    seven days, ``last`` (the newest decisions)."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, approved long, latest long, version long")
        self.days = handle.getMapState("days", "day long", "n long, approved long")
        self.last = handle.getValueState("last", "items string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, approved, latest, version = self.totals.get() if self.totals.exists() else (0, 0, 0, 0)
        items = json.loads(self.last.get()[0]) if self.last.exists() else []
        for part in rows:
            ok = part["approved"]
            n, approved = n + len(part), approved + int(ok.sum())
            latest = max(latest, int(part["second"].max()))
            for day, mine in part.groupby(part["second"] // DAY):
                have = self.days.getValue((day,)) if self.days.containsKey((day,)) else (0, 0)
                self.days.updateValue((day,), (have[0] + len(mine), have[1] + int(mine["approved"].sum())))
                # rolls out of the week even if the shard gets no more rows
                self.handle.registerTimer(int(day + WEEK) * DAY * 1000)
            newest = part.sort_values(["second", "id"], ascending=False).head(self.keep)
            items += [[int(s), int(i), d] for s, i, d in zip(newest["second"], newest["id"], newest["decision"])]
            items = sorted(items, reverse=True)[:self.keep]
        self.last.update((json.dumps(items),))
        self._forget(latest // DAY - WEEK)
        yield self._send(key, n, approved, latest, version + 1, items)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, approved, latest, version = self.totals.get()
        if not self._forget(expiredTimerInfo.getExpiryTimeInMs() // 1000 // DAY - WEEK):
            return
        yield self._send(key, n, approved, latest, version + 1, json.loads(self.last.get()[0]))

    def _forget(self, day: int) -> bool:
        """Drop this day and those before it."""
        old = [k for k in self.days.keys() if k[0] <= day]
        for k in old:
            self.days.removeKey(k)
        return bool(old)

    def _send(self, key, n, approved, latest, version, items) -> pd.DataFrame:
        self.totals.update((n, approved, latest, version))
        out = [(key[0], version, "total", None, n, approved, None, latest, None)]
        out += [(key[0], version, "day", d[0], v[0], v[1], None, None, None) for d, v in self.days.iterator()]
        out += [(key[0], version, "last", None, None, None, i, s, d) for s, i, d in items]
        whole = ["day", "n", "approved", "id", "second"]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _ROWS.split(", ")]).astype({c: "Int64" for c in whole})

    def close(self) -> None:
        pass


def portfolio_stream(decided: DataFrame, ts: str = "app_ts", key: str = "app_id", shards: int = 4, keep: int = 10,
                     watermark: str = "14 days") -> DataFrame:
    """ST-5 on a stream of decided applications (``ts`` a timestamp): rows of
    every shard that changed, to be read by :func:`portfolio_view`. Rows without
    an event time or later than the watermark take no part. The session needs
    the RocksDB state store (see :class:`rocksdb_state`)."""
    x = decided.where(F.col(ts).isNotNull()).withWatermark(ts, watermark).select(
        F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), F.col(ts).alias("at"), F.col(key).cast("long").alias("id"),
        F.unix_seconds(ts).alias("second"), (F.col("decision") == APPROVE).alias("approved"), "decision")
    return x.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=Portfolio(keep), outputStructType=_ROWS, outputMode="Append", timeMode="EventTime")


def _latest(rows: DataFrame) -> DataFrame:
    """The rows of every shard's last version."""
    top = rows.groupBy("shard").agg(F.max("version").alias("version"))
    return rows.join(top, ["shard", "version"])


def portfolio_view(rows: DataFrame) -> DataFrame:
    """The overview of ``monitoring.portfolio_overview``, as of the latest event
    time, from the shards' rows (a fixed number per shard)."""
    x = _latest(rows)
    today = x.where("kind = 'total'").agg(F.floor(F.max("second") / DAY).alias("today"))
    j = x.where("kind <> 'last'").crossJoin(F.broadcast(today))                        # one row
    total = F.col("kind") == "total"
    week, day = (F.col("kind") == "day") & (F.col("day") > F.col("today") - WEEK), (F.col("kind") == "day") & (F.col("day") == F.col("today"))
    some = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    return j.agg(some(total, "n").alias("total_all"), some(week, "n").alias("total_week"), some(day, "n").alias("total_today"),
                 some(total, "approved").alias("approved_all"), some(week, "approved").alias("approved_week"),
                 some(day, "approved").alias("approved_today"))


def last_decisions_view(rows: DataFrame, n: int = 10) -> DataFrame:
    """The newest decisions over all shards: (id, at, decision); ``at`` has no
    time zone."""
    x = _latest(rows).where("kind = 'last'")
    at = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, second)")
    return x.orderBy(F.col("second").desc(), F.col("id").desc()).limit(n).select("id", at.alias("at"), "decision")


class rocksdb_state:
    """Context manager: stream queries started inside keep their state in
    RocksDB, which keyed state with timers needs; the caller's setting comes back."""

    KEY = "spark.sql.streaming.stateStore.providerClass"
    ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.prev = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, self.ROCKS)
        return self.spark

    def __exit__(self, *exc):
        if self.prev is None:
            self.spark.conf.unset(self.KEY)
        else:
            self.spark.conf.set(self.KEY, self.prev)
        return False


def audit_sink(path: str, key: str = "app_id", ts: str = "app_ts", buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """ST-6: a ``foreachBatch`` function that keeps one row per ``key``: the
    first that a batch brings, of several in one batch the earliest by ``ts``.

    A batch goes to a folder of its own number, cut into buckets of the key, and
    leaves out the keys that smaller batch numbers have in the same buckets (a
    join on key and bucket that reads these two columns only). A batch that is
    replayed after a crash replaces its folder with the same rows. So the log
    does not depend on a watermark, and nothing is kept in memory between
    batches. Rows with a NULL key are kept as one key. Read the log with
    :func:`read_audit`."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = F.row_number().over(Window.partitionBy(key).orderBy(F.col(ts).asc_nulls_last(), F.xxhash64(*batch.columns)))
        new = batch.withColumn("__first", first).where("__first = 1").drop("__first") \
            .withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        written = _written(spark, path, batch_id)
        if written:
            old = spark.read.option("basePath", path).parquet(*written).select(F.col(key).alias("__key"), F.col("bucket").alias("__bucket"))
            same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("bucket") == F.col("__bucket"))
            new = new.join(old, same, "left_anti")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id:012d}")
    return write


def _written(spark: SparkSession, path: str, before: int | None = None) -> list[str]:
    """Folders of finished batches, with a smaller number than ``before``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for s in fs.listStatus(root) if fs.exists(root) else []:
        name = s.getPath().getName()
        done = name.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        # a folder without a row has no bucket to read
        if done and (before is None or int(name[6:]) < before) and len(fs.listStatus(s.getPath())) > 1:
            out.append(os.path.join(path, name))
    return sorted(out)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit log that ``audit_sink`` wrote under ``path``."""
    return spark.read.option("basePath", path).parquet(*_written(spark, path)).drop("bucket", "batch")
