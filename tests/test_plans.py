"""Plan-shape checks: no registered query may sort all rows in one task."""

import pytest

# bounded by construction: the Pareto frontier orders the <= 120 sweep rows; the
# offsets of unstratified folds are one row per hash bucket
ALLOWED_GLOBAL_WINDOWS = {"pareto_thresholds", "plain_folds"}
# skipped: building these trains models or runs streams / writes (eager)
SKIP_PREFIX = ("stream_", "model_", "gbt_", "logistic_", "cross_validate", "feature_importance",
               "feature_selection", "batch_predict", "top_features", "platt", "eda_report",
               "csv_round_trip", "report_write", "profile_report", "decision_report", "oof_", "random_search",
               "training_tables", "written_splits", "op", "pipeline", "boosted_", "tree_contributions",
               "select_model", "tpe_search", "minority_")


def _walk(node):
    yield node
    ch = node.children()
    for i in range(ch.size()):
        yield from _walk(ch.apply(i))


def _global_windows(df):
    plan = df._jdf.queryExecution().optimizedPlan()
    return [n for n in _walk(plan) if n.nodeName() == "Window" and n.partitionSpec().isEmpty()]


def test_no_unpartitioned_windows(spark, sf):
    import __spark_entry__ as E
    bad = []
    for name, build in E.queries().items():
        if name.startswith(SKIP_PREFIX) or name in ALLOWED_GLOBAL_WINDOWS:
            continue
        if _global_windows(build(spark, sf)):
            bad.append(name)
    assert bad == []


def test_detector_sees_a_global_window(spark, sf):
    import __spark_entry__ as E
    assert _global_windows(E.queries()["pareto_thresholds"](spark, sf))


def test_only_small_tables_are_broadcast_by_hint(spark, sf):
    """A hinted side may be an aggregate, a literal list or a window over one;
    never rows of a table."""
    import __spark_entry__ as E

    def raw(node):
        """A hinted side that reads a file without an aggregate above it."""
        if node.nodeName() in ("Aggregate", "LocalRelation", "OneRowRelation", "LogicalRDD", "GlobalLimit"):
            return False
        ch = node.children()
        return ch.size() == 0 or any(raw(ch.apply(i)) for i in range(ch.size()))

    bad = []
    for name in ("threshold_sweep", "information_value", "iqr_outliers", "zscore_outliers", "lift_table", "batch_statistics",
                 "describe_applications", "numeric_by_class", "target_encode", "stratified_split", "portfolio_overview",
                 "histogram", "histogram_by_class", "class_weights", "class_weights_positive", "kde_density", "kde_exact", "woe_table",
                 "tradeoff_curve", "risk_pricing", "calibration_curve", "evaluation_report", "roc_curve", "fairness_audit", "missing_patterns"):
        for n in _walk(E.queries()[name](spark, sf)._jdf.queryExecution().analyzed()):
            if n.nodeName() == "ResolvedHint" and raw(n.children().apply(0)):
                bad.append(name)
    assert bad == []


def test_a_fit_reads_its_input_a_few_times(spark, sf, tmp_path):
    """The split is written once; nothing after it goes back to the source."""
    from pyspark.sql import functions as F
    from riskframe.plans import model_queries as M

    copy = str(tmp_path)
    for t in ("orders", "customer", "nation"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{copy}/{t}.parquet")
    split = M._split(spark, copy)
    n = split.count()
    for t in ("orders", "customer", "nation"):         # gone: a second read would fail
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.mode("overwrite").parquet(f"{copy}/{t}.parquet")
    from riskframe.operators import training as T
    from riskframe.sources.fixtures import CATEGORICAL, NUMERIC

    m = T.fit_model(split.where(F.col("split") == "train"), "logistic_regression", NUMERIC, CATEGORICAL)
    assert m.score(split).count() == n > 0
