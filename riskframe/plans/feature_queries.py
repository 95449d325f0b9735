"""Registered sampling (ML-1..3) and feature (FE-*) queries. Every fit uses
the training part of the exact stratified split; transforms apply to all rows."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import sampling as S
from ..sources import fixtures as X
from ..sources.fixtures import CATEGORICAL, NUMERIC, TARGET
from .catalog import Query, register

UNSEEN_CITY = "PERU"  # held out of the training part to exercise unseen categories


def _split_sql(src: str, weights_bp: list[tuple[str, int]], out: str = "split") -> str:
    rn = (f"row_number() OVER (PARTITION BY LoanApproved ORDER BY md5(CAST(app_id AS VARCHAR) || '|42'), app_id)")
    n = "count(*) OVER (PARTITION BY LoanApproved)"
    case = " ".join(f"WHEN rn <= (n * {bp} + 5000) // 10000 THEN '{name}'" for name, bp in weights_bp[:-1])
    return (f"SELECT * EXCLUDE (rn, n), CASE {case} ELSE '{weights_bp[-1][0]}' END AS {out} "
            f"FROM (SELECT *, {rn} AS rn, {n} AS n FROM {src}) t")


SPLIT_CTES = f"""split AS ({_split_sql('applications_dirty', [('train', 8000), ('test', 10000)])}),
train AS (SELECT * FROM split WHERE split = 'train'),
train_seen AS (SELECT * FROM train WHERE City <> '{UNSEEN_CITY}')"""


def _dirty_split(spark, sf):
    return S.stratified_split(X.applications_dirty(spark, sf), TARGET, "app_id")


def _train(spark, sf):
    return _dirty_split(spark, sf).where(F.col("split") == "train")


def _train_seen(spark, sf):
    return _train(spark, sf).where(F.col("City") != UNSEEN_CITY)


# ------------------------------------------------------------------ ML-1/2/3
register(Query(
    "stratified_split", lambda spark, sf: S.stratified_split(X.applications(spark, sf), TARGET, "app_id")
    .select("app_id", TARGET, "split"), operators="ML-1",
    ctes=f"sp AS ({_split_sql('applications', [('train', 8000), ('test', 10000)])})",
    sql="SELECT app_id, LoanApproved, split FROM sp"))

register(Query(
    "stratified_split_3way",
    lambda spark, sf: S.stratified_split(X.applications(spark, sf), TARGET, "app_id", S.SPLIT_701515)
    .select("app_id", TARGET, "split"), operators="ML-1 IO-5",
    ctes=f"sp AS ({_split_sql('applications', [('train', 7000), ('val', 8500), ('test', 10000)])})",
    sql="SELECT app_id, LoanApproved, split FROM sp"))

register(Query(
    "stratified_split_hashed",
    lambda spark, sf: S.stratified_split(X.applications(spark, sf), TARGET, "app_id", exact=False)
    .groupBy("split", TARGET).agg(F.count(F.lit(1)).alias("n")), operators="ML-1",
    sql="""SELECT CASE WHEN CAST(('0x' || substr(md5(CAST(app_id AS VARCHAR) || '|42'), 1, 8)) AS UBIGINT) / 4294967296.0 < 0.8
  THEN 'train' ELSE 'test' END AS split, LoanApproved, count(*) AS n FROM applications GROUP BY ALL"""))

register(Query(
    "stratified_folds", lambda spark, sf: S.stratified_folds(X.applications(spark, sf), TARGET, "app_id")
    .select("app_id", TARGET, "fold"), operators="ML-2",
    sql="""SELECT app_id, LoanApproved, CAST((row_number() OVER (PARTITION BY LoanApproved
  ORDER BY md5(CAST(app_id AS VARCHAR) || '|42'), app_id) - 1) % 5 AS INTEGER) AS fold FROM applications"""))

register(Query(
    "class_weights", lambda spark, sf: S.class_weights(X.applications(spark, sf), TARGET).select("app_id", "weight"),
    operators="ML-3", floats=["weight"],
    sql="""SELECT app_id, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY LoanApproved)) AS weight
FROM applications"""))

register(Query(
    "class_weights_positive",
    lambda spark, sf: S.class_weights(X.scored(spark, sf), "defaulted", positive_only=True).select("app_id", "weight"),
    operators="ML-3", floats=["weight"],
    sql="""SELECT app_id, CASE WHEN defaulted = 1 THEN count_if(defaulted = 0) OVER () / count_if(defaulted = 1) OVER ()
  ELSE 1.0 END AS weight FROM scored"""))


# ------------------------------------------------------------------ FE-1/2/3
def _median_impute(spark, sf):
    med = FE.fit_medians(_train(spark, sf), ["Income", "CreditScore"])
    return FE.impute(_dirty_split(spark, sf), med).select("app_id", "Income", "CreditScore")


register(Query(
    "median_impute", _median_impute, operators="FE-1", floats=["Income", "CreditScore"], ctes=SPLIT_CTES,
    sql="""SELECT app_id, coalesce(Income, (SELECT quantile_cont(Income, 0.5) FROM train)) AS Income,
 coalesce(CAST(CreditScore AS DOUBLE), (SELECT quantile_cont(CAST(CreditScore AS DOUBLE), 0.5) FROM train)) AS CreditScore
FROM split"""))


def _mode_impute(spark, sf):
    mode = FE.fit_modes(_train(spark, sf), ["Gender"])
    return FE.impute(_dirty_split(spark, sf), mode).select("app_id", "Gender")


register(Query(
    "mode_impute", _mode_impute, operators="FE-2", ctes=SPLIT_CTES,
    sql="""SELECT app_id, coalesce(Gender, (SELECT Gender FROM train WHERE Gender IS NOT NULL
  GROUP BY Gender ORDER BY count(*) DESC, Gender LIMIT 1)) AS Gender FROM split"""))


def _impute_strategies(spark, sf):
    tr, d = _train(spark, sf), _dirty_split(spark, sf)
    a = FE.impute_strategy(tr, d, ["Income"], "mean").select("app_id", F.col("Income").alias("income_mean"))
    b = FE.impute_strategy(tr, d, ["Gender"], "constant", "Unknown").select("app_id", F.col("Gender").alias("gender_const"))
    c = FE.impute_strategy(tr, d, ["Income"], "zero").select("app_id", F.col("Income").alias("income_zero"))
    n = FE.impute_strategy(tr, d, ["Income", "Gender"], "drop_row").select("app_id", F.lit(True).alias("complete"))
    return a.join(b, "app_id").join(c, "app_id").join(n, "app_id", "left") \
        .withColumn("complete", F.coalesce("complete", F.lit(False)))


register(Query(
    "impute_strategies", _impute_strategies, operators="FE-3", floats=["income_mean", "income_zero"], ctes=SPLIT_CTES,
    sql="""SELECT app_id, coalesce(Income, (SELECT avg(Income) FROM train)) AS income_mean,
 coalesce(Gender, 'Unknown') AS gender_const, coalesce(Income, 0.0) AS income_zero,
 Income IS NOT NULL AND Gender IS NOT NULL AS complete FROM split"""))


# ------------------------------------------------------------------ FE-4/5
def _zfilter(spark, sf):
    return FE.zscore_filter(X.applications_outlier(spark, sf), NUMERIC).select("app_id")


register(Query(
    "zscore_filter", _zfilter, operators="FE-4",
    ctes="st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)
         + " FROM applications_outlier)",
    sql="SELECT app_id FROM applications_outlier, st WHERE "
        + " AND ".join(f"(CASE WHEN s_{c} = 0 THEN 0.0 ELSE abs(({c} - m_{c}) / s_{c}) END) < 3" for c in NUMERIC)))


def _outliers(spark, sf):
    tr = X.applications_outlier(spark, sf)
    fences = FE.fit_fences(tr, ["Income", "LoanAmount"])
    flagged = FE.outlier_action(tr, fences, "flag").select("app_id", "Income_outlier", "LoanAmount_outlier")
    capped = FE.outlier_action(tr, fences, "cap").select("app_id", F.col("Income").alias("income_capped"),
                                                         F.col("LoanAmount").alias("loan_capped"))
    return flagged.join(capped, "app_id")


register(Query(
    "outlier_flag_cap", _outliers, operators="FE-5", floats=["income_capped", "loan_capped"],
    ctes="""q AS (SELECT quantile_cont(Income, 0.25) AS iq1, quantile_cont(Income, 0.75) AS iq3,
  quantile_cont(LoanAmount, 0.25) AS lq1, quantile_cont(LoanAmount, 0.75) AS lq3 FROM applications_outlier),
f AS (SELECT iq1 - 1.5 * (iq3 - iq1) AS ilo, iq3 + 1.5 * (iq3 - iq1) AS ihi,
  lq1 - 1.5 * (lq3 - lq1) AS llo, lq3 + 1.5 * (lq3 - lq1) AS lhi FROM q)""",
    sql="""SELECT app_id, NOT (Income BETWEEN ilo AND ihi) AS Income_outlier, NOT (LoanAmount BETWEEN llo AND lhi) AS LoanAmount_outlier,
 least(greatest(Income, ilo), ihi) AS income_capped, least(greatest(LoanAmount, llo), lhi) AS loan_capped
FROM applications_outlier, f"""))


# ------------------------------------------------------------------ FE-6/7
def _scale(method):
    def build(spark, sf):
        a = S.stratified_split(X.applications(spark, sf), TARGET, "app_id")
        p = FE.fit_scaler(a.where(F.col("split") == "train"), NUMERIC, method)
        return FE.scale(a, p).select("app_id", *NUMERIC)
    return build


_SCALE_SPLIT = f"sp AS ({_split_sql('applications', [('train', 8000), ('test', 10000)])}), tr AS (SELECT * FROM sp WHERE split = 'train')"


def _scale_sql(center: dict, scale: dict) -> str:
    return "SELECT app_id, " + ", ".join(
        f"(CAST({c} AS DOUBLE) - ({center[c]})) / (CASE WHEN ({scale[c]}) = 0 THEN 1.0 ELSE ({scale[c]}) END) AS {c}"
        for c in NUMERIC) + " FROM sp"


register(Query(
    "standard_scale", _scale("standard"), operators="FE-6", floats=NUMERIC, ctes=_SCALE_SPLIT,
    sql=_scale_sql({c: f"SELECT avg({c}) FROM tr" for c in NUMERIC},
                   {c: f"SELECT stddev_pop({c}) FROM tr" for c in NUMERIC})))

register(Query(
    "robust_scale", _scale("robust"), operators="FE-7", floats=NUMERIC, ctes=_SCALE_SPLIT,
    sql=_scale_sql({c: f"SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM tr" for c in NUMERIC},
                   {c: f"SELECT quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25) FROM tr"
                    for c in NUMERIC})))

register(Query(
    "minmax_scale", _scale("minmax"), operators="FE-7", floats=NUMERIC, ctes=_SCALE_SPLIT,
    sql=_scale_sql({c: f"SELECT CAST(min({c}) AS DOUBLE) FROM tr" for c in NUMERIC},
                   {c: f"SELECT CAST(max({c}) AS DOUBLE) - min({c}) FROM tr" for c in NUMERIC})))


# ------------------------------------------------------------------ FE-8/9
def _melt(df, names):
    """(app_id, feature, value) of the listed (column, name) pairs."""
    return df.select("app_id", F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c, n in names]))
        .alias("kv")).select("app_id", "kv.feature", "kv.value")


def _one_hot(spark, sf):
    vocab = FE.fit_categories(_train_seen(spark, sf), ["Education", "City"])
    out = FE.one_hot(_dirty_split(spark, sf).select("app_id", "Education", "City"), vocab)
    return _melt(out, [(c, c) for c in out.columns if c != "app_id"])


register(Query(
    "one_hot_encode", _one_hot, operators="FE-8",
    ctes=SPLIT_CTES + """,
voc AS (SELECT 'Education' AS f, Education AS v FROM train_seen UNION SELECT 'City', City FROM train_seen),
lv AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS k FROM voc),
kept AS (SELECT f, v FROM lv WHERE k > 1)""",
    sql="""SELECT s.app_id, kept.f || '_' || kept.v AS feature,
  CASE WHEN (kept.f = 'Education' AND s.Education = kept.v) OR (kept.f = 'City' AND s.City = kept.v) THEN 1e0 ELSE 0e0 END AS value
  FROM split s CROSS JOIN kept"""))


def _one_hot_sparse(spark, sf):
    index, sizes = FE.fit_level_index(_train_seen(spark, sf), ["Education", "City"])
    out = FE.one_hot_sparse(_dirty_split(spark, sf).select("app_id", "Education", "City"), index, sizes)
    x = vector_to_array(F.col("one_hot"))
    return out.select("app_id", F.size(x).alias("width"), F.array_join(F.filter(
        F.transform(x, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull()).cast("array<string>"), ",").alias("ones"))


register(Query(
    "one_hot_sparse", _one_hot_sparse, operators="FE-8",
    ctes=SPLIT_CTES + """,
voc AS (SELECT 1 AS f, Education AS v FROM train_seen UNION SELECT 2, City FROM train_seen),
lv AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS k FROM voc),
kept AS (SELECT f, v, row_number() OVER (ORDER BY f, v) - 1 AS i FROM lv WHERE k > 1)""",
    sql="""SELECT s.app_id, CAST((SELECT count(*) FROM kept) AS INTEGER) AS width,
  coalesce(string_agg(CAST(kept.i AS VARCHAR), ',' ORDER BY kept.i), '') AS ones
  FROM split s LEFT JOIN kept ON (kept.f = 1 AND s.Education = kept.v) OR (kept.f = 2 AND s.City = kept.v) GROUP BY s.app_id"""))


def _rare(spark, sf):
    keep = FE.fit_top_categories(_train(spark, sf), ["City"], 10)
    return FE.merge_rare(_dirty_split(spark, sf), keep).select("app_id", "City")


register(Query(
    "rare_category_merge", _rare, operators="FE-9", ctes=SPLIT_CTES + """,
top AS (SELECT City FROM train GROUP BY City ORDER BY count(*) DESC, City LIMIT 10)""",
    sql="SELECT app_id, CASE WHEN City IS NULL THEN NULL WHEN City IN (SELECT City FROM top) THEN City ELSE 'Other' END AS City FROM split"))


# ------------------------------------------------------------------ FE-10/11/12
def _target_enc(spark, sf):
    enc = FE.fit_target_encoding(_train_seen(spark, sf), "City", TARGET, 1.0)
    return FE.apply_target_encoding(_dirty_split(spark, sf).select("app_id", "City"), enc, "City")


register(Query(
    "target_encode", _target_enc, operators="FE-10", floats=["City_te"], ctes=SPLIT_CTES + """,
pr AS (SELECT avg(CAST(LoanApproved AS DOUBLE)) AS prior FROM train_seen),
enc AS (SELECT City, (count(*) * avg(CAST(LoanApproved AS DOUBLE)) + 1.0 * (SELECT prior FROM pr)) / (count(*) + 1.0) AS te
  FROM train_seen GROUP BY City)""",
    sql="SELECT s.app_id, s.City, coalesce(enc.te, (SELECT prior FROM pr)) AS City_te FROM split s LEFT JOIN enc USING (City)"))


def _freq_enc(spark, sf):
    return FE.frequency_encode(_train_seen(spark, sf), _dirty_split(spark, sf).select("app_id", "City"), "City")


register(Query(
    "frequency_encode", _freq_enc, operators="FE-11", floats=["City_freq"], ctes=SPLIT_CTES + """,
fq AS (SELECT City, count(*) / (SELECT count(*) FROM train_seen) AS fr FROM train_seen GROUP BY City)""",
    sql="SELECT s.City, s.app_id, coalesce(fq.fr, 0.0) AS City_freq FROM split s LEFT JOIN fq USING (City)"))

register(Query(
    "ordinal_encode", lambda spark, sf: FE.ordinal_encode(X.applications(spark, sf)).select("app_id", "Education_ord"),
    operators="FE-12",
    sql="""SELECT app_id, CAST(CASE Education WHEN 'HighSchool' THEN 1 WHEN 'Bachelor' THEN 2 WHEN 'Master' THEN 3
  WHEN 'PhD' THEN 4 END AS INTEGER) AS Education_ord FROM applications"""))


# ------------------------------------------------------------------ FE-13/14/15/19
def _bin_sql(c, edges, labels):
    parts = [f"WHEN {c} IS NULL OR {c} < {float(edges[0])} THEN NULL"]
    parts += [f"WHEN {c} < {float(e)} THEN '{lab}'" for e, lab in zip(edges[1:], labels[:-1])]
    return f"CASE {' '.join(parts)} ELSE '{labels[-1]}' END AS {c}_bin"


register(Query(
    "bin_features", lambda spark, sf: FE.bin_features(X.applications(spark, sf))
    .select("app_id", *[f"{c}_bin" for c in FE.BINS]), operators="FE-13",
    sql="SELECT app_id, " + ", ".join(_bin_sql(c, e, lab) for c, (e, lab) in FE.BINS.items()) + " FROM applications"))

register(Query(
    "ratio_features", lambda spark, sf: FE.ratio_features(X.applications(spark, sf))
    .select("app_id", "debt_to_income", "exp_to_age_ratio", "large_loan_flag"), operators="FE-14",
    floats=["debt_to_income", "exp_to_age_ratio"],
    sql="""SELECT app_id, CASE WHEN Income > 0 THEN LoanAmount / Income END AS debt_to_income,
 CASE WHEN Age - 18.0 > 0 THEN YearsExperience / (Age - 18.0) END AS exp_to_age_ratio,
 CASE WHEN Income > 0 THEN LoanAmount / Income END > 5.0 AS large_loan_flag FROM applications"""))

register(Query(
    "finite_to_zero",
    lambda spark, sf: FE.finite_or_zero(X.applications_nan(spark, sf).select("app_id", "LoanAmount"), ["LoanAmount"]),
    operators="FE-15 DQ-12", floats=["LoanAmount"],
    sql="SELECT app_id, CASE WHEN app_id % 31 = 0 OR app_id % 37 = 0 THEN 0.0 ELSE LoanAmount END AS LoanAmount FROM applications"))

_INTER = ["Age", "Income", "CreditScore"]
register(Query(
    "interaction_features", lambda spark, sf: FE.interactions(X.applications(spark, sf).select("app_id", *_INTER), _INTER)
    .drop(*_INTER), operators="FE-19", floats=["Age_x_Income", "Age_x_CreditScore", "Income_x_CreditScore"],
    sql="""SELECT app_id, CAST(Age AS DOUBLE) * Income AS Age_x_Income, CAST(Age AS DOUBLE) * CreditScore AS Age_x_CreditScore,
 Income * CreditScore AS Income_x_CreditScore FROM applications"""))


def _preprocess(spark, sf):
    tr = _train(spark, sf)
    p = FE.fit_preprocessor(tr, NUMERIC, CATEGORICAL)
    vec = FE.assemble(p.transform(_dirty_split(spark, sf)), p.feature_cols)
    x = vector_to_array(F.col("features"))
    return vec.select("app_id", F.explode(F.arrays_zip(
        F.array(*[F.lit(n) for n in p.feature_names]).alias("feature"), x.alias("value"))).alias("kv")) \
        .select("app_id", "kv.feature", "kv.value")


def _preprocess_sql() -> tuple[str, str]:
    med = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS md_{c}" for c in NUMERIC)
    modes = ",\n".join(f"mo_{c} AS (SELECT {c} AS v FROM train WHERE {c} IS NOT NULL GROUP BY {c} "
                       f"ORDER BY count(*) DESC, {c} LIMIT 1)" for c in CATEGORICAL)

    def filled(src):
        return ("SELECT app_id, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), md_{c}) AS {c}" for c in NUMERIC) + ", "
                + ", ".join(f"coalesce({c}, (SELECT v FROM mo_{c})) AS {c}" for c in CATEGORICAL) + f" FROM {src}, med")
    sc = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)
    voc = " UNION ".join(f"SELECT '{c}' AS f, {c} AS v FROM ftrain" for c in CATEGORICAL)
    hit = " OR ".join(f"(k.f = '{c}' AND a.{c} = k.v)" for c in CATEGORICAL)
    ctes = (SPLIT_CTES + f",\nmed AS (SELECT {med} FROM train),\n{modes},\n"
            f"ftrain AS ({filled('train')}),\nfall AS ({filled('split')}),\nsc AS (SELECT {sc} FROM ftrain),\n"
            f"voc AS ({voc}),\nkept AS (SELECT f, v FROM (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS r "
            f"FROM voc) t WHERE r > 1),\n"
            f"oh AS (SELECT a.app_id, k.f || '_' || k.v AS name, CASE WHEN {hit} THEN 1.0 ELSE 0.0 END AS x "
            "FROM fall a CROSS JOIN kept k),\n"
            "zs AS (SELECT app_id, " + ", ".join(
                f"coalesce(({c} - a_{c}) / CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END, 0.0) AS {c}"
                for c in NUMERIC) + " FROM fall, sc)")
    return ctes, ("SELECT app_id, name AS feature, CAST(x AS DOUBLE) AS value FROM oh UNION ALL "
                  + " UNION ALL ".join(f"SELECT app_id, '{c}', {c} FROM zs" for c in NUMERIC))


_PP_CTES, _PP_SQL = _preprocess_sql()
register(Query("preprocess", _preprocess, operators="FE-16 FE-18", ctes=_PP_CTES, sql=_PP_SQL, floats=["value"]))
