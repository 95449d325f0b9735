import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import ordered as O


def skewed(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # a third of all rows share one value (hot key); ties everywhere else too
        x = 42.0 if i % 3 == 0 else float(rnd.randint(0, 500))
        y = float(rnd.gauss(0, 1)) if i % 7 else None
        rows.append((i, x, y, rnd.randint(0, 1)))
    return spark.createDataFrame(rows, "id long, x double, y double, label int"), rows


def test_value_cumsums_matches_brute_force(spark):
    df, rows = skewed(spark)
    cum = O.value_cumsums(df, ["x"], {"cnt": F.lit(1).cast("long"), "pos": F.col("label").cast("long")}, n_buckets=16)
    got = {r["value"]: r for r in cum.collect()}
    xs = np.array([r[1] for r in rows])
    ls = np.array([r[3] for r in rows])
    for v in sorted(set(xs))[:50] + [42.0]:
        r = got[v]
        assert r["cnt_lt"] == int((xs < v).sum()) and r["cnt_le"] == int((xs <= v).sum())
        assert r["pos_lt"] == int(ls[xs < v].sum()) and r["pos_tot"] == int(ls.sum())


@pytest.mark.parametrize("col", ["x", "y"])
def test_exact_quantiles_match_numpy(spark, col):
    df, rows = skewed(spark)
    probs = [0.0, 0.1, 0.25, 0.3333, 0.5, 0.75, 0.9, 1.0]
    q = {r["q"]: r["quantile"] for r in O.exact_quantiles(df, [col], probs, n_buckets=8).collect()}
    idx = 1 if col == "x" else 2
    vals = np.array([r[idx] for r in rows if r[idx] is not None])
    for p in probs:
        assert q[p] == pytest.approx(float(np.quantile(vals, p)), rel=1e-12, abs=1e-12)


def test_exact_quantiles_by_group(spark):
    df, rows = skewed(spark)
    got = O.quantile_table(df, ["x"], [0.5], ["med"], by=["label"]).collect()
    for r in got:
        vals = np.array([row[1] for row in rows if row[3] == r["label"]])
        assert r["med"] == pytest.approx(float(np.median(vals)))


def test_hashed_rank_is_row_number_by_md5(spark):
    import hashlib
    df, rows = skewed(spark, n=1500)
    got = {r["id"]: (r["rn"], r["rn_n"]) for r in O.hashed_rank(df, "id", 42, ["label"]).collect()}
    for lab in (0, 1):
        ids = sorted((hashlib.md5(f"{r[0]}|42".encode()).hexdigest(), r[0]) for r in rows if r[3] == lab)
        for k, (_, i) in enumerate(ids, start=1):
            assert got[i] == (k, len(ids))


def test_edge_cases_empty_single_null_one_class(spark):
    from riskframe.operators import evaluation as V
    from riskframe.operators import profile as P
    empty = spark.createDataFrame([], "x double, label int")
    assert O.exact_quantiles(empty, ["x"], [0.5]).collect() == []
    one = spark.createDataFrame([(3.0, 1)], "x double, label int")
    assert O.exact_quantiles(one, ["x"], [0.0, 0.5, 1.0]).select("quantile").distinct().collect()[0][0] == 3.0
    nulls = spark.createDataFrame([(None, 1), (None, 0)], "x double, label int")
    d = P.describe(nulls, ["x"]).first()
    assert d["count"] == 0 and d["q50"] is None
    # one class only: AUC undefined -> 0.5 for the univariate form, NULL for the metric row
    assert P.univariate_auc(one, ["x"], "label").first()["roc_auc"] == 0.5
    r = V.ranking_metrics(one.withColumnRenamed("label", "defaulted").withColumnRenamed("x", "risk_score")).first()
    assert r["roc_auc"] is None


def test_single_bucket_still_exact(spark):
    df, rows = skewed(spark, n=500)
    q = {r["q"]: r["quantile"] for r in O.exact_quantiles(df, ["x"], [0.25, 0.5], n_buckets=1).collect()}
    vals = np.array([r[1] for r in rows])
    assert q[0.25] == pytest.approx(float(np.quantile(vals, 0.25)))
    assert q[0.5] == pytest.approx(float(np.quantile(vals, 0.5)))


def test_zero_inflated_buckets_are_even(spark):
    """99 % zeros: buckets follow the distinct values, not the rows."""
    df = spark.range(100_000).select(F.when(F.col("id") % 50 == 0, F.col("id") / 7.0).otherwise(0.0).alias("x"))
    placed = O.placed_values(df, ["x"], {"cnt": F.lit(1).cast("long")}, n_buckets=8)
    sizes = [r["count"] for r in placed.groupBy("bucket").count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 2000 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_null_groups_labels_and_keys_are_kept(spark):
    rows = [(i if i % 9 else None, float(i % 5), None if i % 10 == 0 else i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, x double, label int")
    med = {r["label"]: r["med"] for r in O.quantile_table(df, ["x"], [0.5], ["med"], by=["label"]).collect()}
    assert med == {k: float(np.median([x for _, x, y in rows if y == k])) for k in (0, 1, None)}
    from riskframe.operators import profile as P
    from riskframe.operators import sampling as S
    for split in (S.stratified_split(df, "label", "id"), S.stratified_folds(df, "label", "id")):
        assert split.count() == 100
    ranks = sorted(r["rn"] for r in O.hashed_rank(df, "id", 1, ["label"]).where("label IS NULL").collect())
    assert ranks == list(range(1, 11))
    assert sorted(r["label"] is None for r in P.numeric_by_class(df, ["x"], "label").collect()) == [False, False, True]


def test_more_hash_digits_give_the_same_ranks(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("label"))
    a = {r["id"]: r["rn"] for r in O.hashed_rank(df, "id", 42, ["label"]).collect()}
    assert a == {r["id"]: r["rn"] for r in O.hashed_rank(df, "id", 42, ["label"], digits=5).collect()}
