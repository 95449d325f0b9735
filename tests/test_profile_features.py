import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import features as FE
from riskframe.operators import profile as P
from riskframe.operators import quality as Q
from riskframe.operators import sampling as S


def small(spark):
    rng = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({
        "id": np.arange(n), "a": rng.normal(50, 10, n).round(1), "b": rng.exponential(3.0, n).round(2),
        "c": rng.choice(["x", "y", "z"], n, p=[0.5, 0.3, 0.2]), "label": rng.integers(0, 2, n)})
    return spark.createDataFrame(pdf), pdf


def test_describe_matches_pandas(spark):
    df, pdf = small(spark)
    got = {r["feature"]: r for r in P.describe(df, ["a", "b"]).collect()}
    for c in ["a", "b"]:
        d = pdf[c].describe()
        r = got[c]
        assert r["count"] == d["count"] and r["mean"] == pytest.approx(d["mean"])
        assert r["std"] == pytest.approx(d["std"]) and r["q25"] == pytest.approx(d["25%"])
        assert r["q50"] == pytest.approx(d["50%"]) and r["q75"] == pytest.approx(d["75%"])
        assert r["skewness"] == pytest.approx(round(pdf[c].skew(), 3), abs=1.1e-3)
        assert r["kurtosis"] == pytest.approx(round(pdf[c].kurt(), 3), abs=1.1e-3)


def test_histogram_last_bin_closed_and_complete(spark):
    df, pdf = small(spark)
    h = P.histogram(df, ["a"], 30).collect()
    assert len(h) == 30 and sum(r["count"] for r in h) == len(pdf)
    counts, _ = np.histogram(pdf["a"], bins=30)
    assert [r["count"] for r in sorted(h, key=lambda r: r["bin"])] == counts.tolist()


def test_information_value_matches_pandas(spark):
    df, pdf = small(spark)
    got = {r["feature"]: r["iv"] for r in P.information_value(df, ["a"], ["c"], "label").collect()}

    def iv(col):
        ct = pd.crosstab(col, pdf["label"])
        pe = (ct[1] / ct[1].sum()).replace(0, 1e-10)
        pn = (ct[0] / ct[0].sum()).replace(0, 1e-10)
        return float(((pe - pn) * np.log(pe / pn)).sum())
    assert got["c"] == pytest.approx(iv(pdf["c"]))
    assert got["a"] == pytest.approx(iv(pd.qcut(pdf["a"], q=10, duplicates="drop")))


def test_mode_ties_smallest_and_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "g string")
    assert FE.fit_modes(df, ["g"]) == {"g": "a"}
    empty = spark.createDataFrame([(None,)], "g string")
    assert FE.fit_modes(empty, ["g"]) == {"g": "Unknown"}


def test_one_hot_drop_first_unknown_zero(spark):
    tr = spark.createDataFrame([("M",), ("F",), ("Other",)], "g string")
    vocab = FE.fit_categories(tr, ["g"])
    assert vocab == {"g": ["F", "M", "Other"]}
    te = spark.createDataFrame([("F",), ("M",), ("Alien",), (None,)], "g string")
    rows = FE.one_hot(te, vocab, keep_source=True).collect()
    got = {r["g"]: (r["g_M"], r["g_Other"]) for r in rows}
    assert got["F"] == (0.0, 0.0) and got["M"] == (1.0, 0.0) and got["Alien"] == (0.0, 0.0)


def test_target_encoding_unseen_gets_prior(spark):
    tr = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0)], "c string, y int")
    enc = FE.fit_target_encoding(tr, "c", "y", 1.0)
    te = spark.createDataFrame([("a",), ("zzz",)], "c string")
    got = {r["c"]: r["c_te"] for r in FE.apply_target_encoding(te, enc, "c").collect()}
    prior = 2 / 3
    assert got["a"] == pytest.approx((2 * 1.0 + prior) / 3) and got["zzz"] == pytest.approx(prior)


def test_fit_on_train_ignores_test_rows(spark):
    df, pdf = small(spark)
    sp = S.stratified_split(df, "label", "id")
    tr = sp.where(F.col("split") == "train")
    med1 = FE.fit_medians(tr, ["a"])
    poisoned = sp.withColumn("a", F.when(F.col("split") == "test", F.lit(1e9)).otherwise(F.col("a")))
    med2 = FE.fit_medians(poisoned.where(F.col("split") == "train"), ["a"])
    assert med1 == med2


def test_split_exact_and_folds_balanced(spark):
    df, pdf = small(spark)
    sp = S.stratified_split(df, "label", "id", S.SPLIT_701515).toPandas()
    assert len(sp) == len(pdf) and sp["id"].is_unique
    for lab, g in sp.groupby("label"):
        n = len(g)
        assert (g["split"] == "train").sum() == (n * 7000 + 5000) // 10000
    folds = S.stratified_folds(df, "label", "id", k=5).toPandas()
    sizes = folds.groupby(["label", "fold"]).size()
    for lab in (0, 1):
        assert sizes[lab].max() - sizes[lab].min() <= 1


def test_quality_reports(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, 3.0, None)], "a int, b double, c string")
    assert Q.duplicate_count(df).first()["n_duplicates"] == 1
    rep = {r["column"]: (r["missing"], r["pct"], r["high_missing"]) for r in Q.missing_report(df).collect()}
    assert rep == {"b": (2, 66.67, True), "c": (1, 33.33, True)}
    v = {(r["check"], r["column"]): r["violations"]
         for r in Q.validate(df, ["a", "zz"], ["a", "c"], "a").collect()}
    assert v[("missing_column", "zz")] == 1 and v[("non_numeric", "c")] == 2 and v[("target_domain", "a")] == 1


def test_zscore_constant_column_keeps_rows(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, k double")
    assert FE.zscore_filter(df, ["a", "k"]).count() == 3


def test_model_save_load_round_trip(spark, sf):
    import tempfile

    from riskframe.operators import training as T
    from riskframe.plans import reports as R
    from riskframe.sources import fixtures as X
    from riskframe.sources.fixtures import CATEGORICAL, NUMERIC
    s = X.scored(spark, sf)
    m = T.fit_model(s, "logistic_regression", NUMERIC, CATEGORICAL)
    path = tempfile.mkdtemp(prefix="riskframe-model-")
    R.save_fitted(m, path)
    back = R.load_fitted(spark, path)
    a = m.score(s).select("app_id", F.col("probability_default").alias("p1"))
    b = back.score(s).select("app_id", F.col("probability_default").alias("p2"))
    diff = a.join(b, "app_id").agg(F.max(F.abs(F.col("p1") - F.col("p2")))).first()[0]
    assert diff == 0.0
    auc = __import__("riskframe.operators.evaluation", fromlist=["x"]).ranking_metrics(
        m.score(s), "defaulted", "probability_default").first()["roc_auc"]
    assert auc > 0.8


def test_impute_float_median_promotes_int_column(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    med = FE.fit_medians(df, ["x"])
    out = FE.impute(df, med)
    assert dict(out.dtypes)["x"] == "double" and sorted(r["x"] for r in out.collect()) == [1.0, 1.5, 2.0]


def test_random_search_runs_trials_with_cv(spark, sf):
    from riskframe.operators import sampling as S2
    from riskframe.operators import training as T
    from riskframe.sources import fixtures as X
    from riskframe.sources.fixtures import CATEGORICAL, NUMERIC
    folds = S2.stratified_folds(X.scored(spark, sf), "LoanApproved", "app_id", k=3)
    res = T.random_search(folds, "logistic_regression", NUMERIC, CATEGORICAL, n_trials=2, k=3).collect()
    assert [r["trial"] for r in res] == [0, 1]
    assert all(0.5 < r["mean_roc_auc"] <= 1.0 for r in res)


def test_assert_valid_and_reader_suffix(spark, tmp_path):
    from riskframe.sources.io import read_table
    ok = spark.createDataFrame([(1, 0), (2, 1)], "a int, y int")
    Q.assert_valid(ok, ["a", "y"], ["a"], "y")
    bad = spark.createDataFrame([(1, 2)], "a int, y int")
    with pytest.raises(ValueError, match="target_domain"):
        Q.assert_valid(bad, ["a", "y"], ["a"], "y")
    with pytest.raises(ValueError, match="missing_column"):
        Q.assert_valid(ok, ["a", "zz"], ["a"], "y")
    with pytest.raises(ValueError, match="Unsupported"):
        read_table(spark, str(tmp_path / "x.xlsx"))
    p = str(tmp_path / "t.csv")
    spark.createDataFrame([(1.0, float("nan")), (2.0, 3.0)], "a double, b double").write.csv(p, header=True)
    back = read_table(spark, p, schema=__import__("pyspark.sql.types", fromlist=["x"]).StructType.fromDDL("a double, b double"))
    assert sorted((r["a"], r["b"]) for r in back.collect()) == [(1.0, None), (2.0, 3.0)]  # NaN -> NULL on load


def test_write_splits_partition_pruning(spark, sf, tmp_path):
    import io
    from contextlib import redirect_stdout

    from riskframe.sources import fixtures as X
    from riskframe.sources.io import write_splits
    sp = S.stratified_split(X.applications(spark, sf), "LoanApproved", "app_id", S.SPLIT_701515)
    path = str(tmp_path / "splits")
    write_splits(sp, path)
    test = spark.read.parquet(path).where(F.col("split") == "test")
    buf = io.StringIO()
    with redirect_stdout(buf):
        test.explain()
    assert "PartitionFilters: [isnotnull(split" in buf.getvalue()
    assert test.count() == sp.where(F.col("split") == "test").count()


def test_constant_column_is_safe_everywhere(spark):
    df = spark.createDataFrame([(5.0, i % 2, "a") for i in range(50)], "k double, label int, c string")
    d = P.describe(df, ["k"]).first()
    assert d["std"] == 0.0 and d["q50"] == 5.0
    assert P.zscore_outliers(df, ["k"]).first()["n_extreme"] == 0
    assert P.iqr_outliers(df, ["k"]).first()["n_outliers"] == 0
    h = P.histogram(df, ["k"], 10).collect()
    assert sum(r["count"] for r in h) == 50
    assert all(r["density"] is None for r in P.kde(df, ["k"], grid_points=5).collect())
    assert P.univariate_auc(df, ["k"], "label").first()["roc_auc"] == 0.5
    iv = {r["feature"]: r["iv"] for r in P.information_value(df, ["k"], ["c"], "label").collect()}
    assert iv["c"] == pytest.approx(0.0)
    assert FE.fit_scaler(df, ["k"])["k"] == (5.0, 1.0)
    assert Q.near_zero_variance(df, ["k"]).first()["near_zero"] is True


def test_target_encoding_keeps_rows_without_any_category(spark):
    from riskframe.operators import features as FE
    df = spark.createDataFrame([(None, i % 2) for i in range(100)], "c string, y int")
    out = FE.apply_target_encoding(df, FE.fit_target_encoding(df, "c", "y"), "c")
    assert out.count() == 100 and {r["c_te"] for r in out.collect()} == {0.5}


def test_all_columns_and_all_values_are_reported(spark):
    from riskframe.operators import profile as P
    df = spark.range(60).select(*[(F.col("id") * (k + 1)).alias(f"x{k}") for k in range(12)], (F.col("id") % 2).alias("y"),
                                F.col("id").cast("string").alias("c"))
    assert P.numeric_by_class(df, [f"x{k}" for k in range(12)], "y").count() == 24
    assert P.category_counts(df, ["c"]).count() == 60
    top = P.category_counts(df, ["c"], top=5).collect()
    assert sum(r["count"] for r in top) == 60 and [r["count"] for r in top if r["value"] is None] == [55]
    listed = P.category_counts(df, ["c", "y"], max_distinct=50).collect()
    assert [(r["feature"], r["count"], r["rank"]) for r in listed if r["value"] is None] == [("c", 60, 0)]


def test_target_distribution_leaves_nulls_out(spark):
    from riskframe.operators import profile as P
    df = spark.createDataFrame([(None,)] * 10 + [(0,)] * 40 + [(1,)] * 50, "y int")
    got = P.target_distribution(df, "y").collect()
    assert len(got) == 2 and got[0]["imbalance_ratio"] == 1.25 and not got[0]["imbalanced"]


def test_level_names_with_dots_train(spark):
    from riskframe.operators import features as FE
    rows = [(float(i), "St. Louis" if i % 3 else "a.b`c", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, city string, y int")
    p = FE.fit_preprocessor(df, ["x"], ["city"])
    assert p.feature_names == ["x", "city_a.b`c"]
    v = FE.assemble(p.transform(df), p.feature_cols).select("features").first()[0]
    assert len(v) == 2


def test_expected_loss_without_amounts_raises(spark):
    from riskframe.operators import decisions as D
    df = spark.createDataFrame([(0.1 * i, i % 2) for i in range(10)], "risk_score double, defaulted int")
    with pytest.raises(ValueError):
        D.best_thresholds(D.threshold_sweep(df, amount_col=None), "expected_loss")


def test_one_hot_of_many_levels_without_the_driver(spark):
    from riskframe.operators import features as FE
    n = 200_000
    df = spark.range(n).select("id", F.when(F.col("id") == 0, "St. Louis").otherwise(F.format_string("c%06d", "id")).alias("city"),
                               F.lit(None).cast("string").alias("none"))
    index, sizes = FE.fit_level_index(df, ["city", "none"])
    assert sizes == {"city": n, "none": 0}
    new = spark.createDataFrame([(1, "St. Louis"), (2, "c000001"), (3, "c000002"), (4, "unseen"), (5, None)], "id long, city string")
    got = {r["id"]: r["one_hot"] for r in FE.one_hot_sparse(new.withColumn("none", F.lit("x")), index, sizes).collect()}
    assert all(v.size == n - 1 for v in got.values())
    assert {k: v.indices.tolist() for k, v in got.items()} == {1: [], 2: [0], 3: [1], 4: [], 5: []}   # S sorts before c
