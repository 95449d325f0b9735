"""IO-1/2/3/5: readers and writers.

Readers take an explicit schema when given (no inference pass over the data)
and normalise floating NaN / +-inf to NULL, because in Spark NaN is not NULL,
poisons avg/corr and sorts above every number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOAN_SCHEMA = T.StructType([
    T.StructField("Age", T.IntegerType()),
    T.StructField("Income", T.DoubleType()),
    T.StructField("CreditScore", T.IntegerType()),
    T.StructField("LoanAmount", T.DoubleType()),
    T.StructField("YearsExperience", T.IntegerType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("Education", T.StringType()),
    T.StructField("City", T.StringType()),
    T.StructField("EmploymentType", T.StringType()),
    T.StructField("LoanApproved", T.IntegerType()),
])


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Replace NaN and +-inf by NULL in float/double columns (DQ-12 first half)."""
    fcols = [f.name for f in df.schema.fields
             if isinstance(f.dataType, (T.DoubleType, T.FloatType))
             and (cols is None or f.name in cols)]
    if not fcols:
        return df
    repl = {c: F.when(F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf"))), None)
            .otherwise(F.col(c)).alias(c) for c in fcols}
    return df.select([repl.get(c, F.col(c)) for c in df.columns])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               clean_nonfinite: bool = True) -> DataFrame:
    """CSV (with header) or Parquet by suffix; any other suffix is an error."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        df = reader.csv(path)
    elif low.endswith(".parquet"):
        df = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    else:
        raise ValueError(f"Unsupported file format: {path}")
    return nan_to_null(df) if clean_nonfinite else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """IO-2/IO-3: predictions and report tables. Written by the executors in
    parallel; CSV gets a header line per part file."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """IO-5: one directory per split so readers prune partitions."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)
