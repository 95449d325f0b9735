"""EDA-8 / EDA-10 on wide tables, EDA-4 with an error bound."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from riskframe.operators import profile as P
from riskframe.operators import wide as W


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 4))
    rows = []
    for b in base:
        r = [float(b[i % 4] * (1 + i) + rng.normal() + 1e4 * i) if rng.random() > .1 else None for i in range(12)]
        rows.append((*r, 5.0, None, float("nan") if rng.random() < .2 else float(b[0])))
    cols = [f"c{i}" for i in range(12)] + ["flat", "none", "gaps"]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5), cols


def as_dict(df, value):
    return {(r["f1"], r["f2"]): r[value] for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"block": 4, "rows": 20, "hold": 1000}])
def test_equal_to_the_aggregate_form(table, options):
    df, cols = table
    got = as_dict(W.correlation_wide(df, cols, **options), "corr")
    clean = df.withColumn("gaps", F.when(~F.isnan("gaps"), F.col("gaps")))
    want = as_dict(P.correlation_long(clean, cols), "corr")
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] is None if v is None or math.isnan(v) else got[k] == pytest.approx(v, abs=1e-9), k


def test_five_hundred_columns(spark):
    n = 500
    d = spark.range(200).select(*[(F.sin(F.col("id") * (i + 1) * 0.37) + (F.col("id") % (i % 7 + 2))).alias(f"c{i}") for i in range(n)])
    cols = [f"c{i}" for i in range(n)]
    got = P.correlation_long(d, cols)
    x = np.array([[math.sin(r * (i + 1) * 0.37) + r % (i % 7 + 2) for i in range(n)] for r in range(200)])
    want = np.corrcoef(x.T)
    rows = got.collect()
    assert len(rows) == n * n
    assert max(abs(r["corr"] - want[int(r["f1"][1:]), int(r["f2"][1:])]) for r in rows) < 1e-9


def test_vif(table, spark):
    df, cols = table
    some = [c for c in cols if c.startswith("c")]
    got = {r["feature"]: r["vif"] for r in W.vif_wide(df, some).collect()}
    want = {r["feature"]: r["vif"] for r in P.vif(df, some).collect()}
    assert got == pytest.approx(want)
    # against regressions on the other columns
    x = np.array([[r[c] for c in some] for r in df.dropna(subset=some).collect()])
    for i, c in enumerate(some):
        others = np.c_[np.ones(len(x)), np.delete(x, i, axis=1)]
        left = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        assert got[c] == pytest.approx(((x[:, i] - x[:, i].mean()) ** 2).sum() / (left ** 2).sum(), rel=1e-6)
    twice = df.select("c0", F.col("c0").alias("again"), "c1")
    assert [r["vif"] for r in W.vif_wide(twice, ["c0", "again", "c1"]).collect()] == [None] * 3
    assert [r["vif"] for r in W.vif_wide(df.limit(0), ["c0", "c1"]).collect()] == [None] * 2
    assert [r["vif"] for r in W.vif_wide(df, ["c0"]).collect()] == [1.0]


def test_blocks_and_empty(spark, table):
    df, cols = table
    assert W.pair_correlations(df.limit(0), ["c0", "c1"]).count() == 0
    assert as_dict(W.correlation_wide(df, ["c0"]), "corr") == {("c0", "c0"): 1.0}


@pytest.mark.parametrize("tolerance", [1e-2, 1e-4, 1e-7])
def test_density_keeps_its_bound(spark, tolerance):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=900), rng.normal(8, .01, 300), np.full(200, 3.0)])
    df = spark.createDataFrame([(float(v), float(i % 3), 7.0) for i, v in enumerate(x)] + [(None, float("nan"), 7.0)],
                               "a double, b double, flat double").repartition(4)
    got = P.kde_bounded(df, ["a", "b", "flat"], grid_points=60, tolerance=tolerance).collect()
    assert len(got) == 180 and all(r["density"] is None for r in got if r["feature"] == "flat")
    for name, v in (("a", x), ("b", np.arange(len(x)) % 3)):
        h = v.std(ddof=1) * len(v) ** -0.2
        peak = 1 / (h * math.sqrt(2 * math.pi))
        for r in got:
            if r["feature"] == name:
                exact = np.exp(-0.5 * ((r["x"] - v) / h) ** 2).sum() * peak / len(v)
                assert abs(r["density"] - exact) <= r["error_bound"] + 1e-15 <= tolerance * peak * 1.01 + 1e-15
