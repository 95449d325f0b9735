"""Registered data-quality queries (DQ-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources import fixtures as X
from ..sources.fixtures import CATEGORICAL, NUMERIC, TARGET
from .catalog import Query, register

REQUIRED = NUMERIC + CATEGORICAL + [TARGET]
ALL_COLS = ["app_id", "app_ts", *NUMERIC, *CATEGORICAL, TARGET, "risk_score"]


def _validate(spark, sf):
    return Q.validate(X.applications_dirty(spark, sf), REQUIRED, NUMERIC, TARGET)


_req_rows = " UNION ALL ".join(f"SELECT 'missing_column' AS \"check\", '{c}' AS \"column\", CAST(0 AS BIGINT) AS violations"
                               for c in REQUIRED)
_num_rows = " UNION ALL ".join(f"SELECT 'non_numeric', '{c}', CAST(0 AS BIGINT)" for c in NUMERIC)
register(Query(
    "validate_schema", _validate, operators="DQ-1",
    sql=f"""{_req_rows} UNION ALL {_num_rows} UNION ALL
SELECT 'target_domain', 'LoanApproved', count_if(LoanApproved IS NULL OR LoanApproved NOT IN (0, 1))
FROM applications_dirty"""))

register(Query(
    "data_summary", lambda spark, sf: Q.data_summary(X.applications(spark, sf), TARGET), operators="DQ-2",
    floats=["target_ratio"],
    sql="""SELECT count(*) AS n_rows, count_if(LoanApproved = 0) AS n_target_0,
 count_if(LoanApproved = 1) AS n_target_1, sum(LoanApproved) / count(*) AS target_ratio,
 13 AS n_cols FROM applications"""))


# Types of the view's columns (fixed values).
_TYPES = {"app_id": "bigint", "Age": "int", "Income": "double", "CreditScore": "int", "LoanAmount": "double",
          "YearsExperience": "int", "Gender": "string", "Education": "string", "City": "string",
          "EmploymentType": "string", "LoanApproved": "int", "risk_score": "double"}
register(Query(
    "column_summary", lambda spark, sf: Q.column_summary(X.applications_dirty(spark, sf).select(*_TYPES)), operators="DQ-2",
    sql=" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {i} AS position, '{t}' AS dtype, "
                           f"count_if({c} IS NULL) AS nulls FROM applications_dirty" for i, (c, t) in enumerate(_TYPES.items()))))


def _missing(spark, sf):
    return Q.missing_report(X.applications_dirty(spark, sf))


register(Query(
    "missing_report", _missing, operators="DQ-3 DQ-4", floats=["pct"],
    sql="SELECT \"column\", missing, round(missing / n * 100.0, 2) AS pct, "
        "round(missing / n * 100.0, 2) > 20 AS high_missing FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS missing, count(*) AS n "
                             f"FROM applications_dirty" for c in ALL_COLS)
        + ") t WHERE missing > 0"))


def _patterns(spark, sf):
    return Q.missing_patterns(X.applications_dirty(spark, sf), ALL_COLS)


register(Query(
    "missing_patterns", _patterns, operators="DQ-5",
    sql="SELECT " + " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in ALL_COLS)
        + " AS pattern, count(*) AS n_rows FROM applications_dirty GROUP BY 1"))

register(Query(
    "duplicate_count", lambda spark, sf: Q.duplicate_count(X.applications_dup(spark, sf)), operators="DQ-6",
    sql="""SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicates
FROM (SELECT count(*) AS c FROM applications_dup GROUP BY ALL_COLS) t""".replace(
        "ALL_COLS", ", ".join(ALL_COLS))))

register(Query(
    "drop_duplicates", lambda spark, sf: Q.drop_duplicates(X.applications_dup(spark, sf)).select("app_id"),
    operators="DQ-7", sql="SELECT app_id FROM (SELECT DISTINCT * FROM applications_dup) t"))


def _drop_null_target(spark, sf):
    d = X.applications_dirty(spark, sf)
    d = d.withColumn(TARGET, F.when(F.col("app_id") % 29 == 0, None).otherwise(F.col(TARGET)))
    return Q.drop_null_target(d, TARGET).select("app_id", TARGET)


register(Query(
    "drop_null_target", _drop_null_target, operators="DQ-8",
    sql="""SELECT app_id, LoanApproved FROM (SELECT app_id,
 CASE WHEN app_id % 29 = 0 THEN NULL ELSE LoanApproved END AS LoanApproved FROM applications_dirty) t
WHERE LoanApproved IS NOT NULL"""))


def _sparse(spark, sf):
    d = X.applications_dirty(spark, sf).select(*NUMERIC, *CATEGORICAL, "app_id")
    return Q.drop_sparse_rows(d, 0.10, cols=NUMERIC + CATEGORICAL).select("app_id")


register(Query(
    "drop_sparse_rows", _sparse, operators="DQ-9",
    sql="SELECT app_id FROM applications_dirty WHERE ("
        + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in NUMERIC + CATEGORICAL)
        + f") / {float(len(NUMERIC + CATEGORICAL))} <= 1e-1"))


def _ranges(spark, sf):
    return Q.range_flags(X.applications_dirty(spark, sf)).select("app_id", "violations")


register(Query(
    "range_flags", _ranges, operators="DQ-10",
    sql="SELECT app_id, concat_ws(',', "
        + ", ".join(f"CASE WHEN NOT ({c} BETWEEN {lo} AND {hi}) THEN '{c}' END" for c, (lo, hi) in Q.RANGES.items())
        + ") AS violations FROM applications_dirty"))


def _coerce(spark, sf):
    a = X.applications(spark, sf)
    s = a.select(*[F.col(c).cast("string").alias(c) for c in NUMERIC + CATEGORICAL])
    _, rep = Q.coerce_types(s, {"Age": "int", "Income": "double", "CreditScore": "int",
                                "City": "double", "Gender": "int"})
    return rep


register(Query(
    "type_coercion", _coerce, operators="DQ-11",
    sql="""SELECT 'Age' AS "column", 'int' AS target_type, count_if(TRY_CAST(CAST(Age AS VARCHAR) AS INTEGER) IS NULL) AS failures FROM applications
UNION ALL SELECT 'Income', 'double', count_if(TRY_CAST(CAST(Income AS VARCHAR) AS DOUBLE) IS NULL) FROM applications
UNION ALL SELECT 'CreditScore', 'int', count_if(TRY_CAST(CAST(CreditScore AS VARCHAR) AS INTEGER) IS NULL) FROM applications
UNION ALL SELECT 'City', 'double', count_if(TRY_CAST(City AS DOUBLE) IS NULL) FROM applications
UNION ALL SELECT 'Gender', 'int', count_if(TRY_CAST(Gender AS INTEGER) IS NULL) FROM applications"""))


def _nonfinite(spark, sf):
    return Q.drop_nonfinite(X.applications_nan(spark, sf), ["app_id", *NUMERIC]).select("app_id")


register(Query(
    "drop_nonfinite", _nonfinite, operators="DQ-12",
    sql="""SELECT app_id FROM applications
WHERE app_id % 31 <> 0 AND app_id % 37 <> 0 AND Income IS NOT NULL AND LoanAmount IS NOT NULL"""))


def _nzv(spark, sf):
    li = X.read_parquet(spark, f"{sf}/lineitem.parquet")
    return Q.near_zero_variance(li, ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice"])


register(Query(
    "near_zero_variance", _nzv, operators="DQ-13", floats=["variance"], digits={"variance": 2},
    sql=" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", var_samp(CAST({c} AS DOUBLE)) AS variance, count(DISTINCT {c}) AS n_distinct, "
        f"coalesce(var_samp(CAST({c} AS DOUBLE)) <= 1e-8, true) OR count(DISTINCT {c}) <= 1 AS near_zero FROM lineitem"
        for c in ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice"])))
