"""Query catalog: each registered query is a Spark builder ``(spark, sf_dir)
-> DataFrame`` plus, where SQL can express it, the DuckDB oracle text.

Float results are rounded to 6 places on both sides (aggregation order moves
the last digits) and ``+ 0.0`` folds -0.0 into 0.0."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.fixtures import applications_sql


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None          # body after the applications WITH-prefix
    floats: list[str] = field(default_factory=list)
    ctes: str = ""                  # extra CTEs appended to the WITH-prefix
    operators: str = ""             # SURVEY ids covered
    digits: dict[str, int] = field(default_factory=dict)  # per-column rounding (default 6)

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return finish(self.build(spark, sf_dir), self.digits)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        inner = applications_sql(self.ctes) + self.sql
        if not self.floats:
            return inner
        rep = ", ".join(f"round({c}, {self.digits.get(c, 6)}) + 0.0 AS {c}" for c in self.floats)
        return f"SELECT * REPLACE ({rep}) FROM (\n{inner}\n) AS q"


def finish(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    digits = digits or {}
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            d = digits.get(f.name, 6)
            cols.append((F.round(F.col(f.name).cast("double"), d) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


REGISTRY: dict[str, Query] = {}


def register(q: Query) -> Query:
    if q.name in REGISTRY:
        raise ValueError(f"duplicate query {q.name}")
    REGISTRY[q.name] = q
    return q
