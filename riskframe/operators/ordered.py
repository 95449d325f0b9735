"""Order-dependent primitives that stay distributed.

A plain ``Window.orderBy(x)`` with no partition moves every row into one task.
Everything here instead uses a two-level scheme:

1. pre-aggregate to one row per distinct (feature, value) -- partial
   aggregation happens map-side, so a value holding a third of all rows costs
   one row after the combine;
2. range-partition that table of distinct values (Spark samples it, not the
   rows, so a zero-inflated column is cut as evenly as any other) into as many
   buckets as the session has shuffle partitions, and run the running-sum
   window per (feature, bucket). The placed table is checkpointed: the input is
   read once and every consumer sees the same buckets;
3. add per-bucket offsets from a table of (features x groups x buckets) rows.

The results are exact; only the *placement* of work uses a sample.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import literal_table
from ..session import cut_lineage


def long_form(df: DataFrame, cols: list[str], carry: dict[str, Column] | None = None,
              feature: str = "feature", value: str = "value") -> DataFrame:
    """Unpivot ``cols`` to (feature, value, *carry) in one projection
    (explode of an array of structs; no extra scan)."""
    carry = carry or {}
    structs = [F.struct(F.lit(c).alias(feature), F.col(c).cast("double").alias(value)) for c in cols]
    out = df.select(F.explode(F.array(*structs)).alias("__kv"), *[e.alias(k) for k, e in carry.items()])
    return out.select(F.col(f"__kv.{feature}").alias(feature), F.col(f"__kv.{value}").alias(value), *carry.keys())


class ValueTable(NamedTuple):
    """Distinct values with running sums (``rows``) and group totals (``totals``)."""
    rows: DataFrame
    totals: DataFrame


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hint: bool = False) -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the keys come from the left."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(F.broadcast(r) if hint else r, cond, how).drop(*[f"__r_{k}" for k in keys])


def placed_values(df: DataFrame, cols: list[str], weights: dict[str, Column],
                  n_buckets: int | None = None, by: list[str] | None = None) -> DataFrame:
    """One row per (feature, *by, distinct non-NULL value) with the sums of the
    weights and ``bucket``, a value-monotone place of about equal size."""
    by = by or []
    g = ["feature", *by]
    n = n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    agg = long_form(df, cols, carry={**{b: F.col(b) for b in by}, **weights}) \
        .where(F.col("value").isNotNull()).groupBy(*g, "value").agg(*[F.sum(w).alias(w) for w in weights])
    return cut_lineage(agg.repartitionByRange(n, *g, "value").withColumn("bucket", F.spark_partition_id()))


def value_table(df: DataFrame, cols: list[str], weights: dict[str, Column] | None = None,
                n_buckets: int | None = None, by: list[str] | None = None) -> ValueTable:
    """Per (feature, *by, distinct non-NULL value), for every weight w (default:
    ``cnt``, the rows): ``w`` (sum at the value), ``w_lt`` (sum over smaller
    values), ``w_le`` (up to and including it) and ``w_tot`` (group total).
    A NULL in a ``by`` column is a group of its own."""
    by = by or []
    weights = weights or {"cnt": F.lit(1).cast("long")}
    wn, g = list(weights), ["feature", *by]
    agg = placed_values(df, cols, weights, n_buckets, by)
    running = (Window.partitionBy(*g, "bucket").orderBy("value")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = agg.select(*g, "bucket", "value", *wn, *[F.sum(w).over(running).alias(f"__loc_{w}") for w in wn])
    tot = agg.groupBy(*g, "bucket").agg(*[F.sum(w).alias(f"__bt_{w}") for w in wn])
    before = Window.partitionBy(*g).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    offs = tot.select(*g, "bucket",
                      *[F.coalesce(F.sum(f"__bt_{w}").over(before), F.lit(0)).alias(f"__off_{w}") for w in wn],
                      *[F.sum(f"__bt_{w}").over(whole).alias(f"{w}_tot") for w in wn])
    # without groups the offsets are (features x buckets) rows, a bounded
    # broadcast; groups may be many, so Spark decides by size
    j = same(local, offs, [*g, "bucket"], hint=not by)
    out = [F.col(c) for c in g] + [F.col("value")]
    for w in wn:
        le = F.col(f"__off_{w}") + F.col(f"__loc_{w}")
        out += [F.col(w), (le - F.col(w)).alias(f"{w}_lt"), le.alias(f"{w}_le"), F.col(f"{w}_tot")]
    return ValueTable(j.select(*out), offs.select(*g, *[f"{w}_tot" for w in wn]).distinct())


def value_cumsums(df: DataFrame, cols: list[str], weights: dict[str, Column],
                  n_buckets: int | None = None, by: list[str] | None = None) -> DataFrame:
    """The rows of :func:`value_table`."""
    return value_table(df, cols, weights, n_buckets, by).rows


def exact_quantiles(df: DataFrame | None, cols: list[str], probs: list[float], n_buckets: int | None = None,
                    by: list[str] | None = None, table: ValueTable | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (numpy 'linear', DuckDB
    ``quantile_cont``) of each column (per ``by`` group), NULLs ignored.
    Returns one row per (feature, *by, q) with ``quantile``; ``n`` is the
    non-NULL count. ``table``: a value table with ``cnt`` to read instead.

    No task holds a whole column: the value at rank r is found by joining a
    (features x groups x probs) target table to the cumulative counts."""
    by = by or []
    g = ["feature", *by]
    cum, tots = table or value_table(df, cols, None, n_buckets, by)
    pr = literal_table(cum.sparkSession, [(i, float(q)) for i, q in enumerate(probs)], "qi int, q double")
    ns = tots.select(*g, F.col("cnt_tot").alias("n"))
    pos = F.col("q") * (F.col("n") - 1).cast("double")
    tgt = (ns.crossJoin(F.broadcast(pr))                      # a few probabilities
           .select(*g, "qi", "q", "n", pos.alias("pos"))
           .select("*", F.floor("pos").cast("long").alias("r_lo"), F.ceil("pos").cast("long").alias("r_hi")))
    ranks = tgt.select(*[F.col(c).alias(f"t_{c}") for c in g], "qi", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("r_lo").alias("r")),
        F.struct(F.lit(1).alias("side"), F.col("r_hi").alias("r")))).alias("t")) \
        .select(*[f"t_{c}" for c in g], "qi", "t.side", "t.r")
    c = cum.select(*[F.col(x).alias(f"c_{x}") for x in g], "value", "cnt_lt", "cnt_le")
    cond = (F.col("cnt_lt") <= F.col("r")) & (F.col("r") < F.col("cnt_le"))
    for x in g:
        cond = cond & F.col(f"c_{x}").eqNullSafe(F.col(f"t_{x}"))
    # (features x probs) rows without groups
    hit = c.join(ranks if by else F.broadcast(ranks), cond) \
        .select(*[F.col(f"t_{x}").alias(x) for x in g], "qi", "side", "value")
    vals = hit.groupBy(*g, "qi").agg(
        F.max(F.when(F.col("side") == 0, F.col("value"))).alias("v_lo"),
        F.max(F.when(F.col("side") == 1, F.col("value"))).alias("v_hi"))
    frac = F.col("pos") - F.col("r_lo").cast("double")
    return same(tgt, vals, [*g, "qi"]).select(
        *g, "q", "n", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * frac).alias("quantile"))


def quantile_table(df: DataFrame | None, cols: list[str], probs: list[float], names: list[str],
                   by: list[str] | None = None, table: ValueTable | None = None) -> DataFrame:
    """Exact quantiles as one row per (feature, *by), one column per name."""
    by = by or []
    q = exact_quantiles(df, cols, probs, by=by, table=table)
    return q.groupBy("feature", *by).agg(
        F.first("n").alias("n"),
        *[F.max(F.when(F.col("q") == F.lit(float(p)), F.col("quantile"))).alias(nm)
          for p, nm in zip(probs, names)])


def quantile_row(df: DataFrame, col: str, probs: list[float], names: list[str]) -> DataFrame:
    """Exact quantiles of one column as a single wide row (one column per name)."""
    q = exact_quantiles(df, [col], probs)
    return q.groupBy().agg(*[F.max(F.when(F.col("q") == F.lit(float(p)), F.col("quantile"))).alias(n)
                             for p, n in zip(probs, names)])


#: Rows a hash bucket of ``hashed_rank`` should hold at most, on average.
RANK_BUCKET_ROWS = 1_000_000
#: Rows of a task of ``hashed_rank`` beyond which it takes more tasks than the
#: session's number of shuffle partitions; the rows stay dealt out like that.
RANK_TASK_ROWS = 250_000


def hashed_rank(df: DataFrame, key: str, seed: int, by: list[str], out: str = "rn",
                digits: int | None = None) -> DataFrame:
    """Exact ``row_number() OVER (PARTITION BY by ORDER BY md5(key||'|'||seed), key)``
    without putting a whole partition-by group in one task.

    The md5 hex string is uniform, so its first ``digits`` hex digits give
    equal-sized, order-preserving buckets (default: at least 4096, and enough
    for ``RANK_BUCKET_ROWS`` rows each): windows run per (by, bucket), and the
    bucket offsets join back on the same keys, without moving the rows again.
    A NULL in ``by`` is a group of its own; a NULL key hashes as an empty one."""
    tasks = 0
    if digits is None:
        n = max(df.count(), 1)
        tasks = math.ceil(n / RANK_TASK_ROWS)
        digits = min(max(3, math.ceil(math.log(max(n / RANK_BUCKET_ROWS, 1), 16))), 6)
    h = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"|{seed}")))
    # group columns that are never NULL, so that plain equality serves the join
    group = F.to_json(F.struct(*[F.col(b) for b in by])) if by else F.lit("")
    d = df.withColumn("__h", h).withColumn("__g", group).withColumn("__hb", F.substring("__h", 1, digits))
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        d = d.repartition(tasks, "__g", "__hb")
    w = Window.partitionBy("__g", "__hb").orderBy("__h", key)
    local = d.withColumn("__loc", F.row_number().over(w)) \
        .withColumn("__bc", F.count(F.lit(1)).over(Window.partitionBy("__g", "__hb")))
    cnt = local.groupBy("__g", "__hb").agg(F.max("__bc").alias("__c"))
    before = Window.partitionBy("__g").orderBy("__hb").rowsBetween(Window.unboundedPreceding, -1)
    offs = cnt.select("__g", "__hb", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"),
                      F.sum("__c").over(Window.partitionBy("__g")).alias("__n"))
    j = local.join(offs, ["__g", "__hb"])
    return j.withColumn(out, (F.col("__off") + F.col("__loc")).cast("long")) \
        .withColumnRenamed("__n", f"{out}_n").drop("__h", "__g", "__hb", "__loc", "__off", "__bc")
