"""ML-5/6, kinds gbt and gbt_deep: the same trees as Spark's own, folds grown
together as if alone, sums that do not depend on how rows are dealt."""
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from riskframe.operators import gradient_trees as G
from riskframe.operators import training as T
from riskframe.operators.random_bits import JavaRandom, XorShift
from riskframe.operators.sampling import class_weights
from riskframe.plans import reports as R
from riskframe.session import cut_lineage

NUM, CAT = ["a", "b"], ["c", "d"]
SMALL = {"n_estimators": 4, "max_depth": 3}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(4000):
        a, b, c, d = rng.normal(), float(rng.integers(0, 9)), "uvwxyz"[rng.integers(0, 6)], ["p", "q", None][rng.integers(0, 3)]
        z = a * (b > 3) + (c in "uv") - (d == "q") * .7 + rng.normal() * .6
        rows.append((i, float(a) if i % 19 else None, b, c, d, int(z > .4), i % 3))
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, d string, defaulted int, fold int").repartition(5, "id")
    return cut_lineage(df)


def scores(df, name="probability_default"):
    return {r["id"]: r[name] for r in df.select("id", name).collect()}


def shape(model):
    return [(t.heap.tolist(), t.feature.tolist(), t.cut.tolist(), t.value.tolist()) for t in model.trees]


def test_random_numbers_are_sparks(spark):
    theirs = spark._jvm.org.apache.spark.util.random.XORShiftRandom(45)
    want = [theirs.nextDouble() for _ in range(200)]
    assert XorShift.of(45).doubles(150).tolist() == want[:150]
    mine = XorShift.of(45)
    assert [mine.next_double() for _ in range(200)] == want
    assert XorShift.of(45).skipped(2 * 77).doubles(60).tolist() == want[77:137]
    java, own = spark._jvm.java.util.Random(-9), JavaRandom(-9)
    assert [java.nextLong() for _ in range(5)] == [own.next_long() for _ in range(5)]


def test_same_trees_as_spark(data):
    m = T.fit_model(data, "gbt", NUM, CAT, params=SMALL)
    assert isinstance(m.model, G.GradientTrees)                # not one Spark fit per model
    x = class_weights(data, "defaulted", positive_only=True, out="__w")
    ref = T.make_estimator("gbt", 1, SMALL, "__w").fit(m.prep.vector(x))
    want = scores(ref.transform(m.prep.vector(data)).select("id", vector_to_array("probability")[1].alias("p")), "p")
    got = scores(m.score(data))
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6
    own = np.array([v for _, v in m.model.importance()])
    assert np.allclose(own, ref.featureImportances.toArray(), atol=1e-6)


def test_sampled_cuts_as_spark(spark):
    """More rows than the sample for the cuts: by gaps."""
    df = cut_lineage(spark.range(60_000, numPartitions=7).select(
        "id", F.pmod(F.hash("id"), F.lit(99991)).cast("double").alias("a"), F.pmod(F.col("id"), F.lit(7)).cast("double").alias("b"),
        F.lit("k").alias("c"), F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("d"))
        .withColumn("defaulted", (F.col("a") + 9000 * F.col("b") + F.when(F.col("d") == "p", 20000).otherwise(0) > 80000).cast("int")))
    params = {"n_estimators": 2, "max_depth": 4}
    m = T.fit_model(df, "gbt", NUM, CAT, params=params)
    x = class_weights(df, "defaulted", positive_only=True, out="__w")
    ref = T.make_estimator("gbt", 1, params, "__w").fit(m.prep.vector(x))
    want = scores(ref.transform(m.prep.vector(df)).select("id", vector_to_array("probability")[1].alias("p")), "p")
    got = scores(m.score(df))
    assert np.mean([abs(got[k] - want[k]) < 1e-6 for k in want]) > 0.99


def test_folds_together_as_alone(data):
    oof, fm = T.cross_validate(data, "gbt_deep", NUM, CAT, k=3, params=SMALL)
    assert fm.count() == 2 * 3 * len(T.FOLD_METRICS)
    got = scores(oof)
    assert len(got) == 4000
    for i in range(3):
        alone = T.fit_model(data.where(F.col("fold") != i), "gbt_deep", NUM, CAT, params=SMALL)
        want = scores(alone.score(data.where(F.col("fold") == i)))
        assert all(got[k] == v for k, v in want.items())


def test_trees_do_not_depend_on_blocks_and_tasks(data, monkeypatch):
    whole = T.fit_model(data, "gbt", NUM, CAT, params=SMALL)
    monkeypatch.setattr(G, "TASK_ROWS", 60)
    assert shape(T.fit_model(data, "gbt", NUM, CAT, params=SMALL).model) == shape(whole.model)


def test_saved_and_loaded(spark, data, tmp_path):
    m = T.fit_model(data, "gbt", NUM, CAT, params=SMALL)
    R.save_fitted(m, str(tmp_path / "m"))
    back = R.load_fitted(spark, str(tmp_path / "m"))
    assert isinstance(back.model, G.GradientTrees) and scores(back.score(data)) == scores(m.score(data))


def test_levels_unseen_in_training_and_null(spark, data):
    m = T.fit_model(data, "gbt", NUM, CAT, params=SMALL)
    odd = spark.createDataFrame([(1, None, None, "new", None), (2, float("nan"), 2.0, None, "q")], "id long, a double, b double, c string, d string")
    p = scores(m.score(odd))
    assert len(p) == 2 and all(0 < v < 1 and math.isfinite(v) for v in p.values())


def test_one_class_and_constant_columns(spark):
    df = cut_lineage(spark.range(50).select("id", F.lit(1.0).alias("a"), F.lit(2.0).alias("b"), F.lit("u").alias("c"), F.lit("v").alias("d"),
                                            F.lit(1).alias("defaulted")))
    p = scores(T.fit_model(df, "gbt", NUM, CAT, params=SMALL).score(df))
    assert all(0.5 < v <= 1 for v in p.values())


def test_labels_must_be_binary(data):
    with pytest.raises(ValueError, match="labels"):
        T.fit_model(data.withColumn("defaulted", F.col("fold")), "gbt", NUM, CAT, params=SMALL)
