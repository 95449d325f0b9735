"""Work that must stay dealt out over many tasks as tables grow."""
import numpy as np
from pyspark.sql import functions as F
from riskframe.operators import ordered as OR
from riskframe.operators import profile as P
from riskframe.operators import sampling as S


def parts(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_class_weights_keep_rows_where_they_are(spark, monkeypatch):
    df = spark.range(400).select("id", F.when(F.col("id") % 9 != 0, (F.col("id") % 4 == 0).cast("int")).alias("y")).repartition(7, "id")
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for positive in (False, True):
            few = S.class_weights(df, "y", positive_only=positive)
            assert parts(few) == 7                              # not one task per class
            with monkeypatch.context() as m:
                m.setattr(S, "MAX_CLASSES", 2)                  # more classes than are broadcast
                many = S.class_weights(df, "y", positive_only=positive)
                assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    assert S.class_weights(df.limit(0), "y").collect() == []


def test_ranks_take_more_tasks_for_more_rows(spark, monkeypatch):
    df = spark.range(900).select("id", (F.col("id") % 3).alias("c"))
    want = sorted(map(str, OR.hashed_rank(df, "id", 1, ["c"]).collect()))
    monkeypatch.setattr(OR, "RANK_TASK_ROWS", 20)
    got = OR.hashed_rank(df, "id", 1, ["c"])
    assert parts(got) > 30 and sorted(map(str, got.collect())) == want


def test_points_visit_few_bins(monkeypatch):
    """Shells around pivots sent a point to many bins; boxes to a few."""
    import numpy as np
    import pyarrow as pa
    from riskframe.operators import oversampling as O
    monkeypatch.setattr(O, "BIN_ROWS", 100)
    x = np.random.default_rng(5).random((6000, 4))
    bins = O.Bins(x, len(x))
    at = bins.of(x)
    for i in range(bins.count):
        bins.low[i], bins.high[i] = x[at == i].min(axis=0), x[at == i].max(axis=0)
    order = np.argsort(at, kind="stable")
    x, at = x[order], at[order]
    bound = np.array([np.partition(O.squared(x[i:i + 1], x[at == at[i]])[0], 5)[5] for i in range(len(x))])
    vec = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 4).cast(pa.list_(pa.float64()))
    b = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), vec, pa.array(at), pa.array(bound)], names=["id", "vec", "bin", "bound"])
    seen = [(r, c) for row, to in O._asked(bins, b) for r, c in zip(row, to)]
    assert bins.count >= 50 and len(seen) < 12 * len(x)
    full = O.squared(x[:40], x)
    for i in range(40):                                   # no bin that holds one of the 6 nearest is left out
        need = {int(at[j]) for j in np.argsort(full[i])[:6]} - {int(at[i])}
        assert need <= {int(c) for r, c in seen if r == i}


def test_newton_from_a_near_penalty_takes_fewer_passes(spark, sf):
    import numpy as np
    from riskframe.operators import folds as FO
    from riskframe.session import cut_lineage
    from riskframe.sources import fixtures as X
    d = cut_lineage(X.scored(spark, sf).withColumn("fold", F.pmod(F.col("app_id"), F.lit(3)).cast("int")))
    specs = [FO.Spec(0, 0.9), FO.Spec(0, 1.1), FO.Spec(1, 1.0)]
    prep = FO.prepare(d, ["Income", "LoanAmount"], ["Gender"], "defaulted", "fold", 3, specs)
    table = cut_lineage(d.select(*FO.coded(d, prep, "defaulted", "fold")))
    cold = FO.newton(table, prep, specs)
    warm = FO.newton(table, prep, specs, start=cold.beta[[1, 0, 2]])
    assert warm.passes < cold.passes and np.abs(warm.beta - cold.beta).max() < 1e-7


def test_many_moments_stay_compiled(spark):
    """8 columns, NULLs and none at all: the aggregates of describe and of
    the correlations are compiled (a star in the plan) and right."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 8))
    rows = [tuple(None if (i + j) % 11 == 0 else float(v) for j, v in enumerate(r)) for i, r in enumerate(x)]
    cols = [f"c{j}" for j in range(8)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    known = np.array(rows, dtype=float)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        corr, desc = P.correlation_long(df, cols), P.describe(df, cols)
        for out, fn in ((corr, "covar_pop"), (desc, "skewness")):
            plan = out._jdf.queryExecution().executedPlan().toString()
            lines = [ln for ln in plan.splitlines() if "HashAggregate" in ln and fn in ln]
            assert lines and all("*(" in ln for ln in lines)
        got = {(r["f1"], r["f2"]): r["corr"] for r in corr.collect()}
        stats = {r["feature"]: r for r in desc.collect()}
        none = P.correlation_long(df.where("false"), cols).collect(), P.describe(df.where("false"), cols).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(got) == 64
    for i, a in enumerate(cols):
        own = known[~np.isnan(known[:, i]), i]
        assert stats[a]["count"] == len(own) and abs(stats[a]["mean"] - own.mean()) < 1e-12
        assert abs(stats[a]["std"] - own.std(ddof=1)) < 1e-12 and stats[a]["min"] == own.min() and stats[a]["max"] == own.max()
        for j, b in enumerate(cols):
            both = ~np.isnan(known[:, i]) & ~np.isnan(known[:, j])
            assert abs(got[a, b] - np.corrcoef(known[both, i], known[both, j])[0, 1]) < 1e-9
    assert len(none[0]) == 64 and all(r["corr"] is None for r in none[0] if r["f1"] != r["f2"])
    assert len(none[1]) == 8 and all(r["count"] == 0 and r["mean"] is None for r in none[1])
