"""DQ-1..13: validation and data-quality reports. Each report is one
aggregation pass (or a schema check that reads no data)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import literal_table

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)

# Valid ranges per column (fixed values), from the data schema and the request bounds.
RANGES = {"Age": (18, 100), "Income": (1, 1_000_000), "CreditScore": (0, 1000),
          "LoanAmount": (1, 500_000), "YearsExperience": (0, 80)}


def split_columns(df: DataFrame, exclude: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Numeric columns and all others, dates and times included (from the
    schema; reads no data)."""
    ex = set(exclude or [])
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in ex]
    cat = [f.name for f in df.schema.fields if f.name not in num and f.name not in ex]
    return num, cat


def validate(df: DataFrame, required: list[str], numeric: list[str], target: str) -> DataFrame:
    """DQ-1: violation table (check, column, violations) instead of raising at
    the first problem. Schema checks cost nothing; value checks share one agg."""
    spark = df.sparkSession
    present = set(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    rows, aggs = [], []
    for c in required:
        rows.append(("missing_column", c, 0 if c in present else 1))
    for c in numeric:
        if c not in present:
            continue
        if isinstance(types[c], NUMERIC_TYPES):
            rows.append(("non_numeric", c, 0))
        else:
            aggs.append(F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull())
                        .alias(f"non_numeric|{c}"))
    if target in present:
        y = F.col(target)
        aggs.append(F.count_if(y.isNull() | ~y.cast("double").isin(0.0, 1.0)).alias(f"target_domain|{target}"))
    schema = "check string, column string, violations long"
    static = literal_table(spark, rows, schema)
    if not aggs:
        return static
    one = df.agg(*aggs)
    stacked = one.select(F.explode(F.array(*[
        F.struct(F.lit(a.split("|")[0]).alias("check"), F.lit(a.split("|")[1]).alias("column"),
                 F.col(f"`{a}`").cast("long").alias("violations")) for a in one.columns])).alias("v")) \
        .select("v.*")
    return static.unionByName(stacked)


def assert_valid(df: DataFrame, required: list[str], numeric: list[str], target: str) -> None:
    """DQ-1, raising form: ValueError at the first violation (missing column,
    then non-numeric column, then target outside {0, 1}), like a loader that
    refuses bad input. One aggregation pass at most."""
    for r in validate(df, required, numeric, target).collect():
        if r["violations"]:
            raise ValueError(f"{r['check']} violated for column {r['column']!r} ({r['violations']} rows)")


def data_summary(df: DataFrame, target: str) -> DataFrame:
    """DQ-2: rows, columns, target counts and positive ratio in one pass."""
    y = F.col(target)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(y == 0).alias("n_target_0"), F.count_if(y == 1).alias("n_target_1"),
                  F.try_divide(F.sum(y), F.count(F.lit(1))).alias("target_ratio")) \
        .withColumn("n_cols", F.lit(len(df.columns)))


def column_summary(df: DataFrame) -> DataFrame:
    """DQ-2, per column: position, type and NULL count, one pass."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(t).alias("dtype"), F.col(f"n{i}").alias("nulls"))
        for i, (c, t) in enumerate(df.dtypes)])).alias("v")).select("v.*")


def missing_report(df: DataFrame, flag_pct: float = 20.0) -> DataFrame:
    """DQ-3/DQ-4: NULL count and percentage (2 places) per column with any
    NULL; ``high_missing`` marks more than ``flag_pct`` percent."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    long = one.select("__n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(cols)]))
        .alias("v")).select("__n", "v.*")
    pct = F.round(F.col("missing") / F.col("__n") * 100.0, 2)
    return long.where(F.col("missing") > 0).select(
        "column", "missing", pct.alias("pct"), (pct > F.lit(flag_pct)).alias("high_missing"))


def missing_patterns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """DQ-5: count of rows per NULL bitmask ('1' = NULL), all rows."""
    cols = cols or df.columns
    mask = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return df.groupBy(mask.alias("pattern")).agg(F.count(F.lit(1)).alias("n_rows"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """DQ-6: rows beyond the first of each identical group (NULLs equal).
    Group-by on all columns with map-side combine: a row repeated a billion
    times costs one partial row per task."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__c"))
    return g.agg(F.sum("__c").cast("long").alias("n_rows"),
                 F.sum(F.col("__c") - 1).cast("long").alias("n_duplicates"))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """DQ-7."""
    return df.dropDuplicates()


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """DQ-8."""
    return df.where(F.col(target).isNotNull())


def drop_sparse_rows(df: DataFrame, max_missing_frac: float = 0.30, cols: list[str] | None = None) -> DataFrame:
    """DQ-9: drop rows whose share of NULL fields exceeds ``max_missing_frac``."""
    cols = cols or df.columns
    nulls = sum(F.when(F.col(c).isNull(), 1).otherwise(0) for c in cols)
    return df.where(nulls / F.lit(float(len(cols))) <= F.lit(max_missing_frac))


def range_flags(df: DataFrame, ranges: dict | None = None, out: str = "violations") -> DataFrame:
    """DQ-10: comma-separated names of columns outside their valid range
    (NULL values are not range violations); empty string when clean."""
    ranges = ranges or RANGES
    parts = [F.when(~F.col(c).between(lo, hi), F.lit(c)) for c, (lo, hi) in ranges.items() if c in df.columns]
    return df.withColumn(out, F.concat_ws(",", *parts))


def coerce_types(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """DQ-11: ``try_cast`` each column to its target type; returns the coerced
    frame and (column, target_type, failures) counted in one pass."""
    casted = df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c)
                         for c in df.columns])
    fails = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c)
                     for c, t in types.items()])
    rep = fails.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("target_type"), F.col(c).cast("long").alias("failures"))
        for c, t in types.items()])).alias("v")).select("v.*")
    return casted, rep


def drop_nonfinite(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """DQ-12: +-inf and NaN become NULL, then rows with any NULL are dropped."""
    from ..sources.io import nan_to_null
    cols = cols or df.columns
    return nan_to_null(df.select(*cols)).dropna()


def near_zero_variance(df: DataFrame, cols: list[str], var_tol: float = 1e-8,
                       max_distinct: int = 1) -> DataFrame:
    """DQ-13: sample variance and distinct count per column; ``near_zero``
    when variance <= tol or at most ``max_distinct`` distinct values.
    Distinct counts are exact (one partial-aggregated distinct per column)."""
    one = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)],
                 *[F.countDistinct(c).alias(f"d{i}") for i, c in enumerate(cols)])
    long = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("variance"), F.col(f"d{i}").alias("n_distinct"))
        for i, c in enumerate(cols)])).alias("v")).select("v.*")
    return long.withColumn("near_zero", F.coalesce(F.col("variance") <= F.lit(var_tol), F.lit(True))
                           | (F.col("n_distinct") <= F.lit(max_distinct)))
