"""The ``applications`` view: loan applications derived from the driver's
orders / customer / nation tables, plus dirty variants for the quality and
imputation operators.

The DataFrame form below and ``applications_sql()`` compute the same rows;
the SQL text is what the DuckDB oracle runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMERIC = ["Age", "Income", "CreditScore", "LoanAmount", "YearsExperience"]
CATEGORICAL = ["Gender", "Education", "City", "EmploymentType"]
TARGET = "LoanApproved"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: read_parquet(spark, f"{sf_dir}/{n}.parquet") for n in names}


# Column definitions of the view as SQL expressions: the same text is used by
# the DataFrame form (selectExpr: one JVM call per projection) and the oracle.
_BASE_EXPRS = [
    "o_orderkey AS app_id", "o_orderdate AS app_ts",
    "CAST(18 + (o_custkey * 37) % 63 AS INT) AS Age",
    "round(2e4 + (c_acctbal + 1e3) * 12e0, 2) AS Income",
    "CAST(300 + (o_orderkey * 7919) % 551 AS INT) AS CreditScore",
    "o_totalprice AS LoanAmount",
    "CAST((o_custkey * 13) % (1 + (o_custkey * 37) % 63) AS INT) AS YearsExperience",
    "CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' ELSE 'Other' END AS Gender",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'PhD' WHEN '2-HIGH' THEN 'Master' "
    "WHEN '3-MEDIUM' THEN 'Bachelor' ELSE 'HighSchool' END AS Education",
    "n_name AS City",
    "CASE c_mktsegment WHEN 'FURNITURE' THEN 'Retired' WHEN 'HOUSEHOLD' THEN 'Unemployed' "
    "WHEN 'MACHINERY' THEN 'Self-Employed' ELSE 'Employed' END AS EmploymentType",
    "(o_orderkey * 104729) % 1000 AS noise_k",
]
_VIEW_EXPRS = [
    "app_id", "app_ts", "Age", "Income", "CreditScore", "LoanAmount", "YearsExperience",
    "Gender", "Education", "City", "EmploymentType",
    "CASE WHEN (CreditScore - 575) / 1e2 + (Income - 8e4) / 6e4 - (LoanAmount / Income) / 1e1 "
    "+ noise_k / 25e1 - 1e0 > 0e0 THEN 1 ELSE 0 END AS LoanApproved",
    "round(1e0 / (1e0 + exp((CreditScore - 575) / 8e1 + (Income - 8e4) / 6e4 "
    "- (LoanAmount / Income) / 1e1)), 6) AS risk_score",
]


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_tables(spark, sf_dir, ["orders", "customer", "nation"])
    o, c, n = t["orders"], t["customer"], t["nation"]
    # orders x customer is a large-large equi-join (shuffle on custkey; AQE
    # splits a hot customer). nation is a fixed 25-row dimension: Catalyst's
    # size check broadcasts it, no hint needed.
    j = (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
         .join(n, F.col("c_nationkey") == F.col("n_nationkey")))
    return j.selectExpr(*_BASE_EXPRS).selectExpr(*_VIEW_EXPRS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications with the polarity fixed once: ``defaulted = 1 - LoanApproved``
    next to ``risk_score`` = P(default)."""
    return applications(spark, sf_dir).selectExpr("*", "CAST(1 - LoanApproved AS INT) AS defaulted")


def applications_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL Income / Gender and out-of-range CreditScore on a fixed pattern of ids."""
    a = applications(spark, sf_dir)
    return a.select(
        *[F.when(F.col("app_id") % 17 == 0, None).otherwise(F.col(c)).alias(c) if c == "Income"
          else F.when(F.col("app_id") % 23 == 0, None).otherwise(F.col(c)).alias(c) if c == "Gender"
          else F.when(F.col("app_id") % 101 == 0, 1200).otherwise(F.col(c)).alias(c) if c == "CreditScore"
          else F.col(c) for c in a.columns])


def applications_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = applications(spark, sf_dir)
    return a.unionByName(a.filter(F.col("app_id") % 50 == 0))


def applications_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = applications(spark, sf_dir)
    return a.withColumn("Income", F.when(F.col("app_id") % 211 == 0, F.col("Income") * 40)
                        .otherwise(F.col("Income")))


def applications_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = applications(spark, sf_dir)
    return a.withColumn(
        "LoanAmount",
        F.when(F.col("app_id") % 31 == 0, F.lit(float("nan")))
         .when(F.col("app_id") % 37 == 0, F.lit(float("inf")))
         .otherwise(F.col("LoanAmount")))


# ---------------------------------------------------------------- SQL text
# The same view as SQL CTEs (runs unchanged in Spark SQL and DuckDB).
_APPLICATIONS_CTE = ("app_base AS (\n SELECT " + ",\n  ".join(_BASE_EXPRS)
                     + "\n FROM orders JOIN customer ON o_custkey = c_custkey"
                       " JOIN nation ON c_nationkey = n_nationkey),\n"
                     + "applications AS (\n SELECT " + ",\n  ".join(_VIEW_EXPRS) + "\n FROM app_base),\n"
                     + """scored AS (SELECT *, 1 - LoanApproved AS defaulted FROM applications),
applications_dirty AS (
 SELECT app_id, app_ts, Age,
  CASE WHEN app_id % 17 = 0 THEN NULL ELSE Income END AS Income,
  CASE WHEN app_id % 101 = 0 THEN 1200 ELSE CreditScore END AS CreditScore,
  LoanAmount, YearsExperience,
  CASE WHEN app_id % 23 = 0 THEN NULL ELSE Gender END AS Gender,
  Education, City, EmploymentType, LoanApproved, risk_score
 FROM applications),
applications_dup AS (
 SELECT * FROM applications UNION ALL SELECT * FROM applications WHERE app_id % 50 = 0),
applications_outlier AS (
 SELECT * REPLACE (CASE WHEN app_id % 211 = 0 THEN Income * 40 ELSE Income END AS Income)
 FROM applications)""")


def applications_sql(extra_ctes: str = "") -> str:
    """``WITH`` prefix defining applications / scored / dirty variants;
    ``extra_ctes`` (without leading comma) is appended to the same WITH."""
    return "WITH " + _APPLICATIONS_CTE + ((",\n" + extra_ctes) if extra_ctes else "") + "\n"
