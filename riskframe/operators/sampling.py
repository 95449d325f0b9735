"""ML-1..3: stratified splits, stratified folds, class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import hashed_rank, same

# Split presets (fixed values): code 80/20, documented 70/15/15; seed 42.
SPLIT_8020 = {"train": 0.8, "test": 0.2}
SPLIT_701515 = {"train": 0.70, "val": 0.15, "test": 0.15}
SEED = 42
#: Classes up to which the class table goes to every task.
MAX_CLASSES = 1024


def stratified_split(df: DataFrame, label: str, key: str, weights: dict[str, float] | None = None,
                     seed: int = SEED, exact: bool = True, out: str = "split") -> DataFrame:
    """ML-1. ``exact``: within each class, rows ordered by md5(key|seed) get
    the first round(n_c * w_1) rows in split 1, and so on -- exact per-class
    proportions, deterministic, identical in SQL. The rank is computed with
    ``hashed_rank`` (windows per (class, hash bucket); no class in one task).

    ``exact=False``: a hash fraction against cumulative weights -- no shuffle
    at all, proportions exact only in expectation (for very large inputs)."""
    weights = weights or SPLIT_8020
    names = list(weights)
    tot = sum(weights.values())
    cum_bp, acc = [], 0.0
    for n in names:
        acc += weights[n] / tot
        cum_bp.append(int(round(acc * 10000)))
    if not exact:
        h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10) \
            .cast("double") / F.lit(float(16 ** 8))
        expr = None
        for n, b in zip(names, cum_bp):
            cond = h < F.lit(b / 10000.0)
            expr = F.when(cond, F.lit(n)) if expr is None else expr.when(cond, F.lit(n))
        return df.withColumn(out, expr.otherwise(F.lit(names[-1])))
    r = hashed_rank(df, key, seed, [label], out="__rn")
    expr = None
    for n, b in zip(names, cum_bp):
        bound = F.floor((F.col("__rn_n") * F.lit(b) + F.lit(5000)) / F.lit(10000))
        cond = F.col("__rn") <= bound
        expr = F.when(cond, F.lit(n)) if expr is None else expr.when(cond, F.lit(n))
    return r.withColumn(out, expr.otherwise(F.lit(names[-1]))).drop("__rn", "__rn_n")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = SEED,
                     out: str = "fold") -> DataFrame:
    """ML-2: fold = (rank within class by md5(key|seed) - 1) mod k, so every
    fold holds each class in proportion (+-1 row). Usable as
    ``CrossValidator(foldCol=...)``."""
    r = hashed_rank(df, key, seed, [label], out="__rn")
    return r.withColumn(out, F.pmod(F.col("__rn") - 1, F.lit(k)).cast("int")).drop("__rn", "__rn_n")


def plain_folds(df: DataFrame, key: str, k: int = 5, seed: int = SEED, out: str = "fold") -> DataFrame:
    """ML-2, not stratified: fold = (rank by md5(key|seed) - 1) mod k."""
    r = hashed_rank(df, key, seed, [], out="__rn")
    return r.withColumn(out, F.pmod(F.col("__rn") - 1, F.lit(k)).cast("int")).drop("__rn", "__rn_n")


def class_weights(df: DataFrame, label: str, method: str = "balanced",
                  custom: dict | None = None, positive_only: bool = False,
                  out: str = "weight") -> DataFrame:
    """ML-3: ``balanced`` weight n / (n_classes * n_c); ``custom`` mapping;
    ``positive_only`` keeps 1.0 for negatives and puts n_neg / n_pos on the
    positives (the boosting form). A NULL class is a class of its own. The class
    table is counted first: up to ``MAX_CLASSES`` rows are broadcast (a shuffle
    by two classes would put all rows into two tasks), more of them join without
    a hint."""
    if method == "custom":
        m = F.create_map(*[x for k, v in (custom or {}).items() for x in (F.lit(k), F.lit(float(v)))])
        return df.withColumn(out, F.coalesce(m[F.col(label)], F.lit(1.0)))
    cnt = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    tot = cnt.agg(F.sum("__nc").alias("__n"), F.count(F.lit(1)).alias("__k"),
                  F.sum(F.when(F.col(label) == 1, F.col("__nc"))).alias("__pos"),
                  F.sum(F.when(F.col(label) == 0, F.col("__nc"))).alias("__neg"))
    w = cnt.crossJoin(tot)
    if positive_only:
        w = w.select(label, F.when(F.col(label) == 1, F.coalesce(F.try_divide(F.col("__neg"), F.col("__pos")), F.lit(1.0)))
                     .otherwise(F.lit(1.0)).alias(out))
    else:
        w = w.select(label, (F.col("__n") / (F.col("__k") * F.col("__nc"))).alias(out))
    few = w.limit(MAX_CLASSES + 1).collect()
    if len(few) > MAX_CLASSES:
        return same(df, w, [label], "left")
    return same(df, df.sparkSession.createDataFrame(few, w.schema), [label], "left", hint=True)
