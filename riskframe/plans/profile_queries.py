"""Registered profiling queries (EDA-*): loan view and the schema-free
profiler on lineitem."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import profile as P
from ..sources import fixtures as X
from ..sources.fixtures import CATEGORICAL, NUMERIC, TARGET
from .catalog import Query, register

LINEITEM_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS feature, count({c}) AS count, avg({x}) AS mean, stddev_samp({x}) AS std, "
            f"min({x}) AS min, quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.5) AS q50, "
            f"quantile_cont({x}, 0.75) AS q75, max({x}) AS max, round(skewness({x}), 3) AS skewness, "
            f"round(kurtosis({x}), 3) AS kurtosis FROM {table}")
    return "\nUNION ALL ".join(parts)


DESCRIBE_FLOATS = ["mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis"]

register(Query(
    "describe_applications", lambda spark, sf: P.describe(X.applications(spark, sf), NUMERIC),
    operators="EDA-1 EDA-2", floats=DESCRIBE_FLOATS, sql=_describe_sql("applications", NUMERIC)))

register(Query(
    "describe_lineitem",
    lambda spark, sf: P.describe(X.read_parquet(spark, f"{sf}/lineitem.parquet"), LINEITEM_NUM),
    operators="EDA-1 EDA-2 EDA-22", floats=DESCRIBE_FLOATS, sql=_describe_sql("lineitem", LINEITEM_NUM),
    # means of 2-decimal prices over 60,000 rows land exactly on a 7th-digit tie
    # (e.g. 0.0499185); the last float bit then decides the 6-digit rounding
    digits={"mean": 5, "std": 5}))


def _hist_sql(table: str, cols: list[str], bins: int, by: str | None = None) -> str:
    g = f", {by}" if by else ""
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS feature{g}, {x} AS value FROM {table} WHERE {c} IS NOT NULL")
    lf = " UNION ALL ".join(parts)
    b = (f"CASE WHEN hi - lo = 0 THEN 0 ELSE CAST(least(floor((value - lo) * {float(bins)} / (hi - lo)), "
         f"{bins - 1}) AS INTEGER) END")
    using = f"feature{g}"
    return f"""lf AS ({lf}),
rng AS (SELECT feature{g}, min(value) AS lo, max(value) AS hi FROM lf GROUP BY feature{g}),
cnt AS (SELECT lf.feature{', lf.' + by if by else ''}, {b} AS bin, count(*) AS count
        FROM lf JOIN rng USING ({using}) GROUP BY ALL),
grid AS (SELECT feature{g}, lo, hi, CAST(r.bin AS INTEGER) AS bin FROM rng, range({bins}) r(bin))""", \
        f"""SELECT grid.feature{', grid.' + by if by else ''}, grid.bin, lo + grid.bin * ((hi - lo) / {float(bins)}) AS bin_lo,
 CASE WHEN grid.bin = {bins - 1} THEN hi ELSE lo + (grid.bin + 1) * ((hi - lo) / {float(bins)}) END AS bin_hi,
 CAST(coalesce(cnt.count, 0) AS BIGINT) AS count
FROM grid LEFT JOIN cnt USING ({using}, bin)"""


_h_ctes, _h_sql = _hist_sql("applications", NUMERIC, 30)
register(Query(
    "histogram", lambda spark, sf: P.histogram(X.applications(spark, sf), NUMERIC, 30), operators="EDA-3",
    floats=["bin_lo", "bin_hi"], ctes=_h_ctes, sql=_h_sql))

_hc_ctes, _hc_sql = _hist_sql("applications", NUMERIC, 25, by=TARGET)
register(Query(
    "histogram_by_class", lambda spark, sf: P.histogram(X.applications(spark, sf), NUMERIC, 25, by=TARGET),
    operators="EDA-6", floats=["bin_lo", "bin_hi"], ctes=_hc_ctes, sql=_hc_sql))

_hs_ctes, _hs_sql = _hist_sql("scored", ["risk_score"], 20)
register(Query(
    "score_histogram", lambda spark, sf: P.histogram(X.scored(spark, sf), ["risk_score"], 20), operators="EDA-3",
    floats=["bin_lo", "bin_hi"], ctes=_hs_ctes, sql=_hs_sql))


def _kde_sql(table: str, cols: list[str], grid: int = 1000, fine: int = 1024) -> tuple[str, str]:
    lf = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {table} "
                            f"WHERE {c} IS NOT NULL" for c in cols)
    ctes = f"""lf AS ({lf}),
st AS (SELECT feature, min(value) AS lo, max(value) AS hi, count(*) AS n, stddev_samp(value) AS sd
       FROM lf GROUP BY feature),
cells AS (SELECT feature, CASE WHEN hi - lo = 0 THEN 0 ELSE CAST(least(floor((value - lo) * {float(fine)} / (hi - lo)),
   {fine - 1}) AS INTEGER) END AS cell, count(*) AS w FROM lf JOIN st USING (feature) GROUP BY ALL),
cc AS (SELECT feature, w, lo + (cell + 0.5) * (hi - lo) / {float(fine)} AS c, n, sd FROM cells JOIN st USING (feature)),
g AS (SELECT feature, CAST(r.gi AS INTEGER) AS gi,
   lo - (hi - lo) / 2 + r.gi * (2 * (hi - lo)) / {float(grid - 1)} AS x FROM st, range({grid}) r(gi))"""
    sql = f"""SELECT g.feature, gi, x,
 sum(w * exp(-0.5 * ((x - c) / (sd * pow(CAST(n AS DOUBLE), -0.2))) * ((x - c) / (sd * pow(CAST(n AS DOUBLE), -0.2)))))
  / (first(n) * first(sd * pow(CAST(n AS DOUBLE), -0.2)) * {float(np.sqrt(2 * np.pi))!r}) AS density
FROM cc JOIN g USING (feature) GROUP BY g.feature, gi, x"""
    return ctes, sql


_k_ctes, _k_sql = _kde_sql("applications", NUMERIC)
register(Query(
    "kde_density", lambda spark, sf: P.kde(X.applications(spark, sf), NUMERIC), operators="EDA-4",
    floats=["x", "density"], ctes=_k_ctes, sql=_k_sql, digits={"density": 12, "x": 4}))


def _kde_exact(spark, sf):
    """The bounded density in units of 1 / std, so that every column has the
    same digits, and whether its error bound keeps the tolerance."""
    cols, tolerance = ["Income", "CreditScore", "LoanAmount"], 1e-8
    a = X.applications(spark, sf)
    sd = a.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in cols])
    sd = sd.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("sd")) for c in cols])).alias("s")).select("s.*")
    n = a.agg(F.count(F.lit(1)).cast("double").alias("n"))
    d = P.kde_bounded(a, cols, grid_points=100, tolerance=tolerance)
    j = d.join(F.broadcast(sd), d.feature == sd.f).crossJoin(F.broadcast(n))            # three rows and one
    peak = 1 / (F.lit(float(np.sqrt(2 * np.pi))) * F.col("sd") * F.pow("n", F.lit(-0.2)))
    return j.select("feature", "gi", (F.col("density") * F.col("sd")).alias("density"), (F.col("error_bound") <= tolerance * peak).alias("bounded"))


register(Query(
    "kde_exact", _kde_exact, operators="EDA-4", floats=["density"], digits={"density": 5},
    # every row is a kernel of its own
    ctes="""ex AS (SELECT feature, CAST(value AS DOUBLE) AS v FROM (SELECT CAST(Income AS DOUBLE) AS Income, CAST(CreditScore AS DOUBLE) AS CreditScore,
  CAST(LoanAmount AS DOUBLE) AS LoanAmount FROM applications) UNPIVOT (value FOR feature IN (Income, CreditScore, LoanAmount))),
es AS (SELECT feature, min(v) AS lo, max(v) AS hi, CAST(count(*) AS DOUBLE) AS n, stddev_samp(v) AS sd FROM ex GROUP BY feature),
eg AS (SELECT *, CAST(i AS INTEGER) AS gi, lo - (hi - lo) / 2 + i * (2 * (hi - lo)) / 99e0 AS x, sd * pow(n, -0.2) AS h FROM es, range(100) t(i))""",
    sql=f"""SELECT eg.feature, gi, sum(exp(-0.5 * ((x - v) / h) * ((x - v) / h))) * any_value(sd) / any_value(n * h * {float(np.sqrt(2 * np.pi))!r}) AS density,
 true AS bounded FROM eg JOIN ex ON eg.feature = ex.feature GROUP BY eg.feature, gi"""))


def _cat_cte(table: str, cols: list[str]) -> str:
    lf = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM {table} "
                            f"WHERE {c} IS NOT NULL" for c in cols)
    return f"cnt AS (SELECT feature, value, count(*) AS count FROM ({lf}) lf GROUP BY feature, value)"


_CAT_ALL = "SELECT feature, value, count, CAST(NULL AS INTEGER) AS rank FROM cnt"


def _cat_top(top: int, maxd: int) -> str:
    return f"""SELECT feature, value, count, CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY feature ORDER BY count DESC, value) AS rank FROM (
  SELECT *, count(*) OVER (PARTITION BY feature) AS nd FROM cnt) a WHERE nd > 1 AND nd <= {maxd}) b WHERE rank <= {top}
UNION ALL SELECT feature, CAST(NULL AS VARCHAR), CAST(sum(count) AS BIGINT), {top + 1} FROM (
 SELECT *, row_number() OVER (PARTITION BY feature ORDER BY count DESC, value) AS rank FROM (
  SELECT *, count(*) OVER (PARTITION BY feature) AS nd FROM cnt) a WHERE nd > 1 AND nd <= {maxd}) b
 WHERE rank > {top} GROUP BY feature
UNION ALL SELECT feature, CAST(NULL AS VARCHAR), CAST(sum(count) AS BIGINT), 0 FROM cnt GROUP BY feature
 HAVING count(*) <= 1 OR count(*) > {maxd}"""


register(Query(
    "category_counts", lambda spark, sf: P.category_counts(X.applications(spark, sf), CATEGORICAL),
    operators="EDA-5", ctes=_cat_cte("applications", CATEGORICAL), sql=_CAT_ALL))

_PART = ["p_brand", "p_type", "p_name"]
register(Query(
    "category_counts_part",
    lambda spark, sf: P.category_counts(X.read_parquet(spark, f"{sf}/part.parquet"), _PART),
    operators="EDA-5 EDA-22", ctes=_cat_cte("part", _PART), sql=_CAT_ALL))

register(Query(
    "category_counts_top",
    lambda spark, sf: P.category_counts(X.read_parquet(spark, f"{sf}/part.parquet"), _PART, top=10, max_distinct=50),
    operators="EDA-5", ctes=_cat_cte("part", _PART), sql=_cat_top(10, 50)))

register(Query(
    "approval_rate_by_category",
    lambda spark, sf: P.rate_by_category(X.applications(spark, sf), CATEGORICAL, TARGET),
    operators="EDA-7", floats=["rate_pct"],
    sql="SELECT feature, value, count(*) AS count, avg(CAST(y AS DOUBLE)) * 100.0 AS rate_pct FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, LoanApproved AS y FROM applications "
                             f"WHERE {c} IS NOT NULL" for c in CATEGORICAL)
        + ") t GROUP BY feature, value"))


def _corr_sql(table: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                parts.append(f"SELECT '{a}' AS f1, '{b}' AS f2, 1.0::DOUBLE AS corr")
            else:
                parts.append(f"SELECT '{a}' AS f1, '{b}' AS f2, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS corr "
                             f"FROM {table}")
    return " UNION ALL ".join(parts)


register(Query(
    "correlation_matrix", lambda spark, sf: P.correlation_long(X.applications(spark, sf), NUMERIC + [TARGET]),
    operators="EDA-8", floats=["corr"], sql=_corr_sql("applications", NUMERIC + [TARGET])))

_LI_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
register(Query(
    "top_correlated_pairs",
    lambda spark, sf: P.top_correlated_pairs(X.read_parquet(spark, f"{sf}/lineitem.parquet"), _LI_CORR),
    operators="EDA-9", floats=["corr", "abs_corr"],
    ctes="cl AS (" + _corr_sql("lineitem", _LI_CORR) + "), pos AS ("
         + " UNION ALL ".join(f"SELECT '{c}' AS f, {i} AS p" for i, c in enumerate(_LI_CORR)) + ")",
    sql="""SELECT f1, f2, corr, abs(corr) AS abs_corr FROM cl JOIN pos a ON cl.f1 = a.f JOIN pos b ON cl.f2 = b.f
WHERE a.p > b.p ORDER BY abs(corr) DESC, a.p, b.p LIMIT 10"""))



def _vif_sql(table: str, cols: list[str]) -> str:
    """The correlation matrix inverted by sweeping every column in turn."""
    k = range(len(cols))
    sql = "SELECT " + ", ".join(f"{'1e0' if i == j else f'corr(CAST({cols[i]} AS DOUBLE), CAST({cols[j]} AS DOUBLE))'} AS r{i}_{j}"
                                for i in k for j in k) + f" FROM {table}"
    for p in k:
        cell = {(i, j): f"r{i}_{j} - r{i}_{p} * r{p}_{j} / r{p}_{p}" if p not in (i, j) else f"1 / r{p}_{p}" if i == j
                else f"r{p}_{j} / r{p}_{p}" if i == p else f"-r{i}_{p} / r{p}_{p}" for i in k for j in k}
        sql = "SELECT " + ", ".join(f"{e} AS r{i}_{j}" for (i, j), e in cell.items()) + f" FROM ({sql}) s{p}"
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, r{i}_{i} AS vif FROM ({sql}) t{i}" for i, c in enumerate(cols))


register(Query(
    "vif", lambda spark, sf: P.vif(X.applications(spark, sf), NUMERIC), operators="EDA-10", floats=["vif"],
    sql=_vif_sql("applications", NUMERIC)))

#: Products of pairs of columns: a wide table of correlated columns.
_WIDE = [f"{a} * {b}" for i, a in enumerate(NUMERIC) for b in NUMERIC[i:]] + [f"{c} * {c} * {c}" for c in NUMERIC] + \
    [f"{a} * {b} * {c}" for i, a in enumerate(NUMERIC) for j, b in enumerate(NUMERIC[i:], i) for c in NUMERIC[j + 1:] if a != b]
_WIDE_COLS = [f"w{i}" for i in range(len(_WIDE))]


def _wide(spark, sf):
    exprs = [f"CAST(CASE WHEN app_id % {i + 7} > 0 THEN CAST({e.split(' * ')[0]} AS DOUBLE) * {' * '.join(e.split(' * ')[1:])} END AS DOUBLE) AS w{i}"
             for i, e in enumerate(_WIDE)]
    return P.correlation_long(X.applications(spark, sf).selectExpr(*exprs), _WIDE_COLS)


register(Query(
    "correlation_wide", _wide, operators="EDA-8", floats=["corr"],
    ctes="wd AS MATERIALIZED (SELECT " + ", ".join(
        f"CASE WHEN app_id % {i + 7} > 0 THEN CAST({e.split(' * ')[0]} AS DOUBLE) * {' * '.join(e.split(' * ')[1:])} END AS w{i}"
        for i, e in enumerate(_WIDE)) + " FROM applications)",
    sql=_corr_sql("wd", _WIDE_COLS)))

register(Query(
    "vif_pair", lambda spark, sf: P.vif(X.applications(spark, sf), ["CreditScore", "Income"]),
    operators="EDA-10", floats=["vif"],
    sql="""SELECT 'CreditScore' AS feature, 1.0 / (1.0 - r * r) AS vif FROM (SELECT corr(CAST(CreditScore AS DOUBLE), Income) AS r FROM applications) t
UNION ALL SELECT 'Income', 1.0 / (1.0 - r * r) FROM (SELECT corr(CAST(CreditScore AS DOUBLE), Income) AS r FROM applications) t"""))


def _woe_ctes(table: str, numeric: list[str], categorical: list[str], target: str) -> str:
    probs = ", ".join(repr(float(x)) for x in P.DECILES)
    edges = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, unnest(quantile_cont(CAST({c} AS DOUBLE), [{probs}])) AS e FROM {table}"
        for c in numeric)
    lf_num = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, {target} AS y FROM {table}"
                                for c in numeric)
    lf_cat = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS bin, {target} AS y FROM {table}"
                                for c in categorical)
    return f"""ed AS (SELECT DISTINCT feature, e FROM ({edges}) t),
ext AS (SELECT feature, min(e) AS e0, max(e) AS e1, count(*) AS ne FROM ed GROUP BY feature),
nb AS (SELECT l.feature, CAST(CASE WHEN ext.ne < 2 OR l.x < ext.e0 OR l.x > ext.e1 THEN NULL
        ELSE greatest((SELECT count(*) FROM ed WHERE ed.feature = l.feature AND ed.e < l.x), 1) - 1 END AS VARCHAR) AS bin,
        l.y FROM ({lf_num}) l JOIN ext USING (feature)),
lb AS (SELECT feature, bin, y FROM nb UNION ALL {lf_cat}),
cnt AS (SELECT feature, bin, count_if(y = 1) AS events, count_if(y = 0) AS non_events
        FROM lb WHERE bin IS NOT NULL AND y IS NOT NULL GROUP BY feature, bin),
wt AS (SELECT *, sum(events) OVER (PARTITION BY feature) AS te, sum(non_events) OVER (PARTITION BY feature) AS tn
       FROM cnt),
woe AS (SELECT feature, bin, events, non_events,
  CASE WHEN events = 0 THEN 1e-10 ELSE events / te END AS pct_events,
  CASE WHEN non_events = 0 THEN 1e-10 ELSE non_events / tn END AS pct_non_events, te, tn FROM wt)"""


_W_CTES = _woe_ctes("applications", NUMERIC, CATEGORICAL, TARGET)
register(Query(
    "woe_table",
    lambda spark, sf: P.woe_table(X.applications(spark, sf), NUMERIC, CATEGORICAL, TARGET).drop("__one_class"),
    operators="EDA-13", floats=["pct_events", "pct_non_events", "woe", "iv_term"], ctes=_W_CTES,
    sql="""SELECT feature, bin, events, non_events, pct_events, pct_non_events, ln(pct_events / pct_non_events) AS woe,
 (pct_events - pct_non_events) * ln(pct_events / pct_non_events) AS iv_term FROM woe"""))

register(Query(
    "information_value",
    lambda spark, sf: P.information_value(X.applications(spark, sf), NUMERIC, CATEGORICAL, TARGET),
    operators="EDA-11 EDA-12", floats=["iv"], ctes=_W_CTES,
    sql="""SELECT feature, CASE WHEN max(CASE WHEN te = 0 OR tn = 0 THEN 1 ELSE 0 END) = 1 THEN 0.0
 ELSE sum((pct_events - pct_non_events) * ln(pct_events / pct_non_events)) END AS iv FROM woe GROUP BY feature"""))


def _auc_sql(table: str, cols: list[str], target: str) -> str:
    """Mann-Whitney form with average ranks (a different route from the
    Spark prefix-sum form)."""
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS feature, CASE WHEN P = 0 OR N = 0 THEN 0.5 ELSE
 (sr - P * (P + 1) / 2.0) / (CAST(P AS DOUBLE) * N) END AS roc_auc
FROM (SELECT sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS sr, count_if(y = 1) AS P, count_if(y = 0) AS N
 FROM (SELECT y, (rank() OVER (ORDER BY x) + rank() OVER (ORDER BY x) + count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r
  FROM (SELECT CAST({c} AS DOUBLE) AS x, {target} AS y FROM {table} WHERE {c} IS NOT NULL AND {target} IS NOT NULL) s) t) u""")
    return "\nUNION ALL ".join(parts)


register(Query(
    "univariate_auc", lambda spark, sf: P.univariate_auc(X.applications(spark, sf), NUMERIC, TARGET),
    operators="EDA-14", floats=["roc_auc"], sql=_auc_sql("applications", NUMERIC, TARGET)))


def _iqr_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS feature, q1, median, q3, lo_fence, hi_fence,
 (SELECT count(*) FROM {table} WHERE {x} < lo_fence OR {x} > hi_fence) AS n_outliers,
 (SELECT min({x}) FROM {table} WHERE {x} >= lo_fence) AS whisker_lo,
 (SELECT max({x}) FROM {table} WHERE {x} <= hi_fence) AS whisker_hi
FROM (SELECT q1, median, q3, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence
 FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q3
  FROM {table}) a) b""")
    return "\nUNION ALL ".join(parts)


register(Query(
    "iqr_outliers", lambda spark, sf: P.iqr_outliers(X.applications_outlier(spark, sf), NUMERIC),
    operators="EDA-15 EDA-16", floats=["q1", "median", "q3", "lo_fence", "hi_fence", "whisker_lo", "whisker_hi"],
    sql=_iqr_sql("applications_outlier", NUMERIC)))


def _z_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS feature, count_if(abs((v - m) / s) > 3) AS n_extreme
FROM (SELECT v, avg(v) OVER () AS m, stddev_pop(v) OVER () AS s
 FROM (SELECT coalesce({x}, (SELECT quantile_cont({x}, 0.5) FROM {table})) AS v FROM {table}) a) b""")
    return "\nUNION ALL ".join(parts)


register(Query(
    "zscore_outliers", lambda spark, sf: P.zscore_outliers(X.applications_outlier(spark, sf), NUMERIC),
    operators="EDA-17", sql=_z_sql("applications_outlier", NUMERIC)))

register(Query(
    "target_distribution", lambda spark, sf: P.target_distribution(X.applications(spark, sf), TARGET),
    operators="EDA-18", floats=["pct", "imbalance_ratio"],
    sql="""SELECT LoanApproved AS target, count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS pct,
 max(count(*)) OVER () / min(count(*)) OVER () AS imbalance_ratio,
 max(count(*)) OVER () / min(count(*)) OVER () > 3 AS imbalanced
FROM applications GROUP BY LoanApproved"""))

register(Query(
    "target_distribution_quality",
    lambda spark, sf: P.target_distribution(X.read_parquet(spark, f"{sf}/labels.parquet"), "quality"),
    operators="EDA-18", floats=["pct", "imbalance_ratio"],
    sql="""SELECT quality AS target, count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS pct,
 max(count(*)) OVER () / min(count(*)) OVER () AS imbalance_ratio,
 max(count(*)) OVER () / min(count(*)) OVER () > 3 AS imbalanced
FROM labels GROUP BY quality"""))


register(Query(
    "target_histogram", lambda spark, sf: P.target_histogram(X.applications(spark, sf), "Income"), operators="EDA-18",
    floats=["bin_lo", "bin_hi"],
    ctes="""mm AS (SELECT min(Income) AS lo, max(Income) AS hi FROM applications),
b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((Income - lo) * 40.0 / (hi - lo)) AS INTEGER), 39) END AS bin
  FROM applications, mm WHERE Income IS NOT NULL)""",
    sql="""SELECT CAST(g.i AS INTEGER) AS bin, lo + g.i * (hi - lo) / 40.0 AS bin_lo,
 CASE WHEN g.i = 39 THEN hi ELSE lo + (g.i + 1) * (hi - lo) / 40.0 END AS bin_hi,
 (SELECT count(*) FROM b WHERE b.bin = g.i) AS count FROM range(40) g(i), mm"""))


def _by_class_sql(table: str, cols: list[str], target: str) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS feature, {target}, min({x}) AS min, max({x}) AS max, avg({x}) AS mean,
 quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q75
FROM {table} WHERE {c} IS NOT NULL GROUP BY {target}""")
    return "\nUNION ALL ".join(parts)


register(Query(
    "numeric_by_class", lambda spark, sf: P.numeric_by_class(X.applications(spark, sf), NUMERIC, TARGET),
    operators="EDA-19", floats=["min", "max", "mean", "q25", "median", "q75"],
    sql=_by_class_sql("applications", NUMERIC, TARGET)))

register(Query(
    "top_variance",
    lambda spark, sf: P.top_variance(X.read_parquet(spark, f"{sf}/lineitem.parquet"),
                                     ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber",
                                      "l_partkey", "l_suppkey"]),
    operators="EDA-20", floats=["variance"], digits={"variance": 2},
    sql="SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, var_samp(CAST({c} AS DOUBLE)) AS variance FROM lineitem"
        for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"])
        + ") t ORDER BY variance DESC, feature LIMIT 5"))


def _pairgrid_sql(table: str, cols: list[str], bins: int = 10) -> str:
    ext = ", ".join(f"min(CAST({c} AS DOUBLE)) AS lo{i}, max(CAST({c} AS DOUBLE)) AS hi{i}" for i, c in enumerate(cols))

    def b(i, c):
        return (f"CASE WHEN hi{i} - lo{i} = 0 THEN 0 ELSE CAST(least(floor((CAST({c} AS DOUBLE) - lo{i}) * {float(bins)} "
                f"/ (hi{i} - lo{i})), {bins - 1}) AS INTEGER) END")
    parts = []
    for ai, a in enumerate(cols):
        for ci in range(ai + 1, len(cols)):
            c = cols[ci]
            parts.append(f"SELECT '{a}' AS f1, '{c}' AS f2, {b(ai, a)} AS bin1, {b(ci, c)} AS bin2 FROM {table}, ext")
    return f"SELECT f1, f2, bin1, bin2, count(*) AS count FROM ({' UNION ALL '.join(parts)}) t " \
           f"WHERE bin1 IS NOT NULL AND bin2 IS NOT NULL GROUP BY ALL", f"ext AS (SELECT {ext} FROM {table})"


_pg_sql, _pg_ctes = _pairgrid_sql("applications", NUMERIC)
register(Query(
    "pair_grid", lambda spark, sf: P.pair_grid(X.applications(spark, sf), NUMERIC), operators="EDA-20",
    ctes=_pg_ctes, sql=_pg_sql))
