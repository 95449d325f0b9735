"""EDA-8, EDA-10 for wide tables: blocked cross-products.

A plan with one ``corr`` per pair does not compile for hundreds of columns.
Here a task multiplies its rows, as matrices, one pair of column blocks at a
time; with masks for NULLs that gives, per pair of columns, the count, sums,
sums of squares and cross-products of the rows where both are known. The
partial blocks are added up per block pair in Spark, and correlations come out
as rows. The driver gets nothing but, for the VIF, a columns x columns matrix."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import literal_table

#: Columns in a block; rows multiplied at a time; bytes of partial sums that a
#: task holds before it sends them on; columns of a VIF matrix at most.
BLOCK, ROWS, HOLD_BYTES, MAX_VIF = 64, 4096, 128 << 20, 4096

_PART = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("sums", pa.binary())])
_PART_DDL = "i int, j int, sums binary"


def _finite(c: str):
    x = F.col(f"`{c}`").cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def _means(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Column means (0 without values), some columns to an aggregate so that it
    stays compiled; they only keep the squares small."""
    out = []
    for a in range(0, len(cols), 200):
        row = df.agg(*[F.avg(_finite(c)).alias(f"m{i}") for i, c in enumerate(cols[a:a + 200])]).first()
        out += [v if v is not None else 0.0 for v in row]
    return np.array(out)


def _blocks(k: int, block: int) -> list[tuple[int, int]]:
    n = -(-k // block)
    return [(i, j) for i in range(n) for j in range(i, n)]


def _cross_products(k: int, shift: np.ndarray, complete: bool, block: int, rows: int, hold: int):
    """Per block pair: 6 matrices (count, sum x, sum y, sum xx, sum yy, sum xy)."""
    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}

        def flush():
            for (i, j), v in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([v.tobytes()], pa.binary())], schema=_PART)
            held.clear()

        for b in batches:
            for a in range(0, b.num_rows, rows):
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.slice(a, rows).columns], axis=1) - shift
                known = ~np.isnan(x)
                if complete:
                    x = x[known.all(axis=1)]
                    known = np.ones(x.shape, dtype=bool)
                m = known.astype(float)
                x = np.where(known, x, 0.0)
                for i, j in _blocks(k, block):
                    p, q = slice(i * block, (i + 1) * block), slice(j * block, (j + 1) * block)
                    s = np.stack([m[:, p].T @ m[:, q], x[:, p].T @ m[:, q], m[:, p].T @ x[:, q],
                                  (x[:, p] ** 2).T @ m[:, q], m[:, p].T @ x[:, q] ** 2, x[:, p].T @ x[:, q]])
                    if (i, j) in held:
                        held[i, j] += s
                    else:
                        held[i, j] = s
                if sum(v.nbytes for v in held.values()) > hold:
                    yield from flush()
        yield from flush()
    return run


_CORR = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("corr", pa.float64())])
_CORR_DDL = "a int, b int, n long, corr double"


def _correlations(t: pa.Table, k: int, block: int) -> pa.Table:
    """The partial sums of one block pair to its correlations; NULL where a
    column is constant over the pair's rows or fewer than two rows are known."""
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    total = None
    for v in t.column("sums"):
        s = np.frombuffer(v.as_buffer(), dtype=np.float64)
        total = s.copy() if total is None else total + s
    width = min(block, k - i * block)
    n, sx, sy, sxx, syy, sxy = total.reshape(6, width, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        # what is left of a constant's squares is rounding
        flat = (n < 2) | (vx <= 1e-12 * sxx) | (vy <= 1e-12 * syy) | (vx <= 0) | (vy <= 0)
        r = np.where(flat, np.nan, (sxy - sx * sy / n) / np.sqrt(vx * vy))
    a, b = np.meshgrid(np.arange(n.shape[0]) + i * block, np.arange(n.shape[1]) + j * block, indexing="ij")
    r = np.clip(r, -1.0, 1.0)
    pick = a.ravel() < b.ravel()
    corr = pa.array(r.ravel()[pick], mask=np.isnan(r.ravel()[pick]))
    return pa.Table.from_arrays([pa.array(a.ravel()[pick], pa.int32()), pa.array(b.ravel()[pick], pa.int32()),
                                 pa.array(n.ravel()[pick].astype(np.int64)), corr], schema=_CORR)


def pair_correlations(df: DataFrame, cols: list[str], complete: bool = False, *, block: int = BLOCK, rows: int = ROWS,
                      hold: int = HOLD_BYTES) -> DataFrame:
    """(a, b, n, corr): Pearson correlation of every two columns, by number, a <
    b, over the ``n`` rows where both are known and finite (``complete``: all
    of them). The number of columns is not limited."""
    k = len(cols)
    shift = _means(df, cols)
    part = df.select(*[_finite(c).alias(f"x{i}") for i, c in enumerate(cols)]).mapInArrow(_cross_products(k, shift, complete, block, rows, hold), _PART_DDL)
    return part.groupBy("i", "j").applyInArrow(lambda t: _correlations(t, k, block), _CORR_DDL)


def correlation_wide(df: DataFrame, cols: list[str], **options) -> DataFrame:
    """EDA-8 as blocked cross-products: (f1, f2, corr), both directions and the
    diagonal, like ``profile.correlation_long``."""
    names = F.lit(list(cols))
    name = lambda c: F.element_at(names, F.col(c) + 1)
    both = F.array(F.struct(name("a").alias("f1"), name("b").alias("f2"), "corr"),
                   F.struct(name("b").alias("f1"), name("a").alias("f2"), "corr"))
    pairs = pair_correlations(df, cols, **options).select(F.explode(both).alias("v")).select("v.*")
    return pairs.unionByName(literal_table(df.sparkSession, [(c, c, 1.0) for c in cols], "f1 string, f2 string, corr double"))


def inverse_diagonal(r: np.ndarray) -> list[float | None]:
    """Diagonal of the inverse of a correlation matrix, by its Cholesky factor;
    None for all if it is singular or holds an unknown."""
    k = len(r)
    if not np.isfinite(r).all() or np.linalg.cond(r) >= 1e12:
        return [None] * k
    try:
        lower = np.linalg.cholesky(r)
    except np.linalg.LinAlgError:
        return [None] * k
    half = np.linalg.solve(lower, np.eye(k))
    return [float(v) for v in (half * half).sum(axis=0)]


def vif_wide(df: DataFrame, cols: list[str]) -> DataFrame:
    """EDA-10 as blocked cross-products: (feature, vif) over complete cases, of
    at most ``MAX_VIF`` columns. Singular or empty: NULL."""
    if len(cols) > MAX_VIF:
        raise ValueError(f"more than {MAX_VIF} columns")
    r = np.eye(len(cols))
    got = pair_correlations(df, cols, complete=True).toArrow()
    if len(cols) > 1 and not got.num_rows:
        r[:] = math.nan
    for a, b, v in zip(*(got.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "corr"))):
        r[a, b] = r[b, a] = v
    return literal_table(df.sparkSession, list(zip(cols, inverse_diagonal(r))), "feature string, vif double")
