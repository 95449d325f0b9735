"""Column-expression building blocks (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

APPROVE, REVIEW, REJECT = "APPROVE", "REVIEW", "REJECT"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r6(x) -> Column:
    """Round to 6 places: float results are compared across engines at this
    precision (aggregation order moves the last digits)."""
    return F.round(_c(x), 6)


def safe_div(num, den, zero=0.0) -> Column:
    """num / den, or ``zero`` when den is 0 or NULL (reference rates are 0 on
    an empty denominator)."""
    den = _c(den)
    return F.when(den.isNull() | (den == 0), F.lit(zero)).otherwise(_c(num) / den)


def finite_or_null(x) -> Column:
    x = _c(x)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def decision_expr(score, approve: float = 0.30, reject: float = 0.70) -> Column:
    """DEC-1: score < approve -> APPROVE; score > reject -> REJECT; else REVIEW.
    Both bounds and NULL / NaN scores fall to REVIEW (NaN compares false in the
    reference; Spark would call NaN greater than any number, so guard it)."""
    s = _c(score)
    ok = s.isNotNull() & ~F.isnan(s)
    return (F.when(ok & (s < F.lit(float(approve))), F.lit(APPROVE))
            .when(ok & (s > F.lit(float(reject))), F.lit(REJECT))
            .otherwise(F.lit(REVIEW)))


def decision_code_expr(decision) -> Column:
    d = _c(decision)
    return (F.when(d == APPROVE, 1).when(d == REJECT, -1).when(d == REVIEW, 0)
            .otherwise(None).cast("int"))


# Risk banding presets (fixed values): (edges, labels, closed side).
# closed='right': bins (e_i, e_{i+1}]; closed='left': [e_i, e_{i+1}).
# Outer bins are open-ended unless the preset starts at an explicit lower edge.
BAND_PRESETS = {
    # batch predictor: (0, .3] Low, (.3, .7] Medium, (.7, 1] High; 0 itself -> NULL
    "predictor": ([0.0, 0.3, 0.7, 1.0], ["Low Risk", "Medium Risk", "High Risk"], "right"),
    # single prediction: < .3 Low, > .7 High, else Medium
    "single": ([0.3, 0.7], ["Low Risk", "Medium Risk", "High Risk"], "single"),
    # dashboard: [0, .33) Low, [.33, .67) Medium, [.67, inf) High
    "dashboard": ([0.33, 0.67], ["Low Risk", "Medium Risk", "High Risk"], "left"),
    # decision engine segments, left-closed, five bands
    "segments": ([0.2, 0.4, 0.6, 0.8],
                 ["Very Low Risk", "Low Risk", "Medium Risk", "High Risk", "Very High Risk"], "left"),
    # decisioning policy document, quartile bands
    "policy": ([0.25, 0.5, 0.75], ["Low Risk", "Moderate Risk", "High Risk", "Very High Risk"], "left"),
}


def band_expr(score, preset: str | None = "segments", edges=None, labels=None,
              closed: str | None = None) -> Column:
    """DEC-3: one banding operator generated from edges + labels + closed side.

    * ``left``  with k edges and k+1 labels: x < e0 -> l0, x < e1 -> l1, ..., else l_k
    * ``right`` with k+1 edges and k labels: bins (e_i, e_{i+1}]; outside -> NULL
    * ``single``: x < e0 -> l0, x > e1 -> l2, else l1
    """
    if preset is not None:
        edges, labels, closed = BAND_PRESETS[preset]
    s = _c(score)
    if closed == "left":
        expr = F.when(s < F.lit(float(edges[0])), labels[0])
        for e, lab in zip(edges[1:], labels[1:-1]):
            expr = expr.when(s < F.lit(float(e)), lab)
        return F.when(s.isNull() | F.isnan(s), None).otherwise(expr.otherwise(labels[-1]))
    if closed == "right":
        expr = None
        for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
            cond = (s > F.lit(float(lo))) & (s <= F.lit(float(hi)))
            expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
        return expr.otherwise(F.lit(None).cast("string"))
    if closed == "single":
        return (F.when(s < F.lit(float(edges[0])), labels[0])
                .when(s > F.lit(float(edges[1])), labels[2]).otherwise(labels[1]))
    raise ValueError(f"unknown closed side {closed!r}")


def _sql_literal(v, dtype) -> str:
    from pyspark.sql import types as T
    if v is None:
        return "NULL"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        f = float(v)
        if f != f:
            return "CAST('NaN' AS DOUBLE)"
        if f in (float("inf"), float("-inf")):
            return "CAST('%sInfinity' AS DOUBLE)" % ("-" if f < 0 else "")
        return repr(f) + "D"
    if isinstance(dtype, T.BooleanType):
        return "true" if v else "false"
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return str(int(v))
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark, rows: list[tuple], schema: str):
    """A small fixed table as an SQL ``VALUES`` list (a local relation in the
    plan: no Python worker, no pickled RDD, nothing to compile). ``schema`` is
    a DDL string such as ``"qi int, q double"``."""
    from pyspark.sql import types as T
    st = T.StructType.fromDDL(schema)
    cols = [f"CAST(c{i} AS {f.dataType.simpleString()}) AS `{f.name}`" for i, f in enumerate(st.fields)]
    names = ", ".join(f"c{i}" for i in range(len(st.fields)))
    if not rows:
        nulls = ", ".join("NULL" for _ in st.fields)
        return spark.sql(f"SELECT {', '.join(cols)} FROM VALUES ({nulls}) AS t({names}) WHERE false")
    vals = ", ".join("(" + ", ".join(_sql_literal(v, f.dataType) for v, f in zip(r, st.fields)) + ")" for r in rows)
    return spark.sql(f"SELECT {', '.join(cols)} FROM VALUES {vals} AS t({names})")
