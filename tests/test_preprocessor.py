"""FE-16 / FE-18 with any number of levels."""
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from riskframe.operators import features as FE
from riskframe.operators import training as T
from riskframe.plans import reports as R
from riskframe.sources import fixtures as X

NUM, CAT = ["Age", "Income"], ["Gender", "Education", "City"]


@pytest.fixture(scope="module")
def loans(spark, sf):
    d = X.scored(spark, sf)
    return d.withColumn("Gender", F.when(F.col("app_id") % 5 > 0, F.col("Gender"))) \
        .withColumn("Income", F.when(F.col("app_id") % 7 > 0, F.col("Income"))).withColumn("empty", F.lit(None).cast("string"))


def test_sparse_equals_dense(spark, loans, monkeypatch, tmp_path):
    train, test = loans.where("app_id % 3 > 0 AND City <> 'NATION_3'"), loans.where("app_id % 3 = 0")
    cat = [*CAT, "empty"]
    dense = T.fit_model(train, "logistic_regression", NUM, cat)
    monkeypatch.setattr(FE, "DENSE_LEVELS", 0)
    sparse = T.fit_model(train, "logistic_regression", NUM, cat)
    assert isinstance(dense.prep, FE.Preprocessor) and isinstance(sparse.prep, FE.SparsePreprocessor)
    assert sparse.prep.modes == dense.prep.modes
    names = {r.position: r.feature for r in sparse.prep.names().collect()}
    assert [names[i] for i in range(len(names))] == dense.prep.feature_names
    vec = lambda p: {r.app_id: r.v for r in p.vector(test).select("app_id", vector_to_array("features").alias("v")).collect()}
    a, b = vec(dense.prep), vec(sparse.prep)                   # unseen levels and NULLs too
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    score = lambda m: {r.app_id: r.probability_default for r in m.score(test).select("app_id", "probability_default").collect()}
    assert score(sparse) == pytest.approx(score(dense), abs=1e-6)
    imp = lambda m: {r.feature: r.value for r in T.feature_importance(m).collect()}
    assert imp(sparse) == pytest.approx(imp(dense), abs=1e-5)
    R.save_fitted(sparse, str(tmp_path / "m"))
    back = R.load_fitted(spark, str(tmp_path / "m"))
    assert score(back) == pytest.approx(score(sparse), abs=1e-12)
    with pytest.raises(ValueError, match="too many for trees"):
        T.fit_model(train, "boosted", NUM, cat)


def test_trees_saved_and_loaded(spark, loans, tmp_path):
    m = T.fit_model(loans, "boosted_leafwise", NUM, CAT, params={"n_estimators": 2})
    R.save_fitted(m, str(tmp_path / "t"))
    back = R.load_fitted(spark, str(tmp_path / "t"))
    a = m.score(loans).agg(F.sum("probability_default"), F.sum("prediction")).first()
    assert back.score(loans).agg(F.sum("probability_default"), F.sum("prediction")).first() == pytest.approx(a)
    assert sum(r.importance for r in T.feature_importance(m).collect()) == pytest.approx(1)


def test_two_hundred_thousand_levels(spark):
    d = spark.range(400_000).select(
        F.col("id"), (F.col("id") % 97).cast("double").alias("x"), F.concat(F.lit("c"), (F.col("id") % 200_000).cast("string")).alias("city"),
        ((F.col("id") * 7919) % 100 < F.col("id") % 97).cast("int").alias("y"))
    m = T.fit_model(d, "logistic_regression", ["x"], ["city"], label="y", params={"max_iter": 3})
    assert isinstance(m.prep, FE.SparsePreprocessor) and m.prep.sizes == {"city": 200_000}
    assert m.model.numFeatures == 200_000                     # x and every level but the first
    got = m.score(d.where("id < 1000")).agg(F.count("probability_default"), F.avg("probability_default")).first()
    assert got[0] == 1000 and 0 < got[1] < 1
