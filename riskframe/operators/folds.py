"""ML-8, ML-12: logistic regressions of many folds and penalties fitted together.

A model is a held-out fold and a penalty; it learns from all rows outside its
fold. One pass over the data adds every row to the gradient and Hessian of all
models but those that hold it out, so the number of passes is that of Newton
steps and does not grow with the models. What a model's preparation needs
(medians, modes, levels, moments, class counts) comes from tables by fold, as
the whole minus the fold that is held out. The driver holds the Hessians:
models x features squared numbers, with at most ``MAX_FEATURES`` features."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import value_cumsums
from .profile import long_form_str

MAX_FEATURES = 1024
#: Level number of a NULL.
NONE = -1
#: Rows of the design matrix that are multiplied at a time.
SLICE = 2048


@dataclass(frozen=True)
class Spec:
    """A model: the fold it leaves out (None: none) and the inverse penalty."""
    fold: int | None
    C: float = 1.0


class TooWide(ValueError):
    """More features than a Hessian on the driver may have."""


@dataclass
class Prepared:
    """Per model: fill values, scale, levels in use, modes and class weights.
    Features: the numeric columns, then every level of every categorical one."""
    numeric: list[str]
    categorical: list[str]
    levels: list[list[str]]                 # all levels, sorted, by column
    fill: np.ndarray                        # models x numeric
    mean: np.ndarray
    std: np.ndarray
    mode: np.ndarray                        # models x categorical: level number
    active: np.ndarray                      # models x features
    weight: np.ndarray                      # models x 2 (class 0, class 1)
    fold: np.ndarray                        # per model; -1: none

    @property
    def names(self) -> list[str]:
        return self.numeric + [f"{c}_{v}" for c, all_ in zip(self.categorical, self.levels) for v in all_]

    def pick(self, models: list[int]) -> Prepared:
        """The preparation of these models, in this order."""
        arrays = {f: getattr(self, f)[models] for f in ("fill", "mean", "std", "mode", "active", "weight", "fold")}
        return replace(self, **arrays)

    def design(self, m: int, x: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Rows of model ``m``: intercept, scaled numbers, one-hot levels."""
        n, p = x.shape
        out = np.zeros((n, 1 + self.active.shape[1]))
        out[:, 0] = 1.0
        z = (np.where(np.isnan(x), self.fill[m], x) - self.mean[m]) / self.std[m]
        out[:, 1:1 + p] = np.where(np.isfinite(z), z, 0.0)
        at = 1 + p
        rows = np.arange(n)
        for j, all_ in enumerate(self.levels):
            lv = np.where(level[:, j] == NONE, self.mode[m, j], level[:, j])
            out[rows, at + lv] = 1.0
            at += len(all_)
        out[:, 1:] *= self.active[m]
        return out


def _medians_by_fold(df: DataFrame, numeric: list[str], fold_col: str, k: int) -> np.ndarray:
    """(k + 1) x numeric: exact medians without each fold, then of all rows."""
    kept = {f"n{i}": (F.col(fold_col) != i).cast("long") for i in range(k)} | {f"n{k}": F.lit(1).cast("long")}
    cum = value_cumsums(df, numeric, kept)
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), *[F.col(f"n{i}_{s}").alias(s) for s in ("lt", "le", "tot")])
                              for i in range(k + 1)]))
    long = cum.select("feature", "value", one.alias("x")).select("feature", "value", "x.*")
    at = (F.col("tot") - 1) / 2.0
    hit = lambda r: F.max(F.when((F.col("lt") <= r) & (r < F.col("le")), F.col("value")))
    out = np.full((k + 1, len(numeric)), np.nan)
    for r in long.where("tot > 0").groupBy("feature", "m").agg(hit(F.floor(at)).alias("a"), hit(F.ceil(at)).alias("b")).collect():
        out[r["m"], numeric.index(r["feature"])] = r["a"] + (r["b"] - r["a"]) * 0.5 if r["a"] != r["b"] else r["a"]
    return out


def prepare(df: DataFrame, numeric: list[str], categorical: list[str], label: str, fold_col: str, k: int, specs: list[Spec],
            balanced: bool = True) -> Prepared:
    """Preparation of every model, from three passes over ``df`` for all."""
    medians = _medians_by_fold(df, numeric, fold_col, k)
    shift = np.where(np.isfinite(medians[k]), medians[k], 0.0)        # keeps squares small
    x = [F.col(c).cast("double") for c in numeric]
    known = [v.isNotNull() & ~F.isnan(v) for v in x]
    off = [F.when(ok, v - F.lit(float(s))) for v, ok, s in zip(x, known, shift)]
    parts = [F.count(o) for o in off] + [F.coalesce(F.sum(o), F.lit(0.0)) for o in off] + [F.coalesce(F.sum(o * o), F.lit(0.0)) for o in off]
    sums = df.groupBy(fold_col).agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1), *[p.alias(f"s{i}") for i, p in enumerate(parts)]).collect()
    by_fold = {r[0]: np.array([float(v) for v in r[1:]]) for r in sums}
    whole = sum(by_fold.values()) if by_fold else np.zeros(2 + 3 * len(numeric))
    if categorical:
        counts = cut_lineage(long_form_str(df, categorical, carry={fold_col: F.col(fold_col)})
                             .groupBy("feature", "value", fold_col).agg(F.count(F.lit(1)).alias("n")))
    wide = counts.where("value IS NOT NULL").select("feature", "value").distinct().count() if categorical else 0
    if wide + len(numeric) > MAX_FEATURES:
        raise TooWide(f"{wide + len(numeric)} features")
    seen: dict[str, dict] = {c: {} for c in categorical}
    for r in counts.collect() if categorical else []:               # at most MAX_FEATURES levels x folds rows
        seen[r["feature"]].setdefault(r["value"], {})[r[fold_col]] = r["n"]
    n_of = lambda c, v, s: sum(n for f, n in seen[c].get(v, {}).items() if s.fold is None or f != s.fold)
    modes, used, levels = [], [], []
    for c in categorical:
        values = [v for v in seen[c] if v is not None]
        mine_modes, mine_used = [], []
        for s in specs:
            n = {v: n_of(c, v, s) for v in values}
            some = [v for v in values if n[v]]
            mode = min(some, key=lambda v: (-n[v], v)) if some else "Unknown"
            mine_modes.append(mode)
            mine_used.append(sorted(set(some) | ({mode} if n_of(c, None, s) else set())))
        modes.append(mine_modes)
        used.append(mine_used)
        levels.append(sorted(set(values) | set(mine_modes)))
    p, d, m = len(numeric), len(numeric) + sum(map(len, levels)), len(specs)
    out = Prepared(numeric, categorical, levels, np.zeros((m, p)), np.zeros((m, p)), np.ones((m, p)),
                   np.zeros((m, len(categorical)), dtype=np.int64), np.zeros((m, d)), np.ones((m, 2)),
                   np.array([-1 if s.fold is None else s.fold for s in specs]))
    for i, s in enumerate(specs):
        t = whole - by_fold.get(s.fold, 0 * whole) if s.fold is not None else whole
        n, ones, have, first, second = t[0], t[1], t[2:2 + p], t[2 + p:2 + 2 * p], t[2 + 2 * p:]
        med = medians[k if s.fold is None else s.fold]
        gap = np.where(np.isfinite(med), med - shift, 0.0)
        rows = np.where(np.isfinite(med), n, have)                   # a column without any value stays unfilled
        miss = rows - have
        mean = (first + miss * gap) / np.maximum(rows, 1)
        var = np.maximum((second + miss * gap * gap) / np.maximum(rows, 1) - mean * mean, 0.0)
        out.fill[i], out.mean[i] = np.where(np.isfinite(med), med, np.nan), mean + shift
        out.std[i] = np.where(var > 0, np.sqrt(var), 1.0)
        out.active[i, :p] = 1.0
        at = p
        for j in range(len(categorical)):
            out.mode[i, j] = levels[j].index(modes[j][i])
            for v in used[j][i][1:]:
                out.active[i, at + levels[j].index(v)] = 1.0
            at += len(levels[j])
        if balanced and n:
            out.weight[i] = [n / (2 * max(n - ones, 1)), n / (2 * max(ones, 1))]
    return out


def coded(df: DataFrame, prep: Prepared, label: str, fold_col: str) -> list:
    """Columns that a pass reads: fold, label, numbers, level numbers. NULL is
    ``NONE``; an unseen value is level 0, which no model gives a coefficient
    (it is the first of every model that has it)."""
    out = [F.coalesce(F.col(fold_col).cast("int"), F.lit(-2)).alias("__fold"), F.col(label).cast("double").alias("__y")]
    out += [F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(prep.numeric)]
    for j, (c, all_) in enumerate(zip(prep.categorical, prep.levels)):
        number = F.create_map(*[F.lit(x) for i, v in enumerate(all_) for x in (v, i)])
        out.append(F.when(F.col(c).isNull(), F.lit(NONE)).otherwise(F.coalesce(F.try_element_at(number, F.col(c).cast("string")), F.lit(0)))
                   .cast("int").alias(f"__l{j}"))
    return out


def _arrays(b: pa.RecordBatch, first: int, p: int, c: int):
    x = np.stack([b.column(first + 2 + i).to_numpy(zero_copy_only=False) for i in range(p)], axis=1) if p else np.zeros((b.num_rows, 0))
    lv = np.stack([b.column(first + 2 + p + j).to_numpy() for j in range(c)], axis=1) if c else np.zeros((b.num_rows, 0), dtype=int)
    return b.column(first).to_numpy(), b.column(first + 1).to_numpy(zero_copy_only=False), x.astype(float), lv


def _log_loss(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, margin) - y * margin


def sums_of(table: DataFrame, prep: Prepared, beta: np.ndarray, models: list[int]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per model: loss, gradient and Hessian over its rows; one pass for all."""
    p, c, d = len(prep.numeric), len(prep.categorical), beta.shape[1]
    schema = pa.schema([("cell", pa.int64()), ("v", pa.float64())])
    size = 1 + d + d * d
    alike: dict[bytes, list[int]] = {}              # models of one preparation share its rows
    for i, m in enumerate(models):
        alike.setdefault(b"".join(np.ascontiguousarray(a[m]).tobytes() for a in (prep.fold, prep.fill, prep.mean, prep.std, prep.mode, prep.active)), []).append(i)
    groups = list(alike.values())

    def run(batches):
        total = np.zeros((len(models), size))
        for b in batches:
            for a in range(0, b.num_rows, SLICE):
                fold, y, x, lv = _arrays(b.slice(a, SLICE), 0, p, c)
                for some in groups:
                    m = models[some[0]]
                    use = np.flatnonzero((fold != prep.fold[m]) & ~np.isnan(y))
                    z = prep.design(m, x[use], lv[use])
                    t = y[use]
                    margins = z @ beta[[models[i] for i in some]].T
                    for i, margin in zip(some, margins.T):
                        w = np.where(t == 1, prep.weight[models[i], 1], prep.weight[models[i], 0])
                        prob = 1.0 / (1.0 + np.exp(-margin))
                        total[i, 0] += w @ _log_loss(margin, t)
                        total[i, 1:1 + d] += z.T @ (w * (prob - t))
                        total[i, 1 + d:] += (z.T @ (z * (w * prob * (1 - prob))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], schema=schema)

    got = table.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(len(models) * size)
    flat[got.column("cell").to_numpy()] = got.column("v").to_numpy()
    return {m: (float(f[0]), f[1:1 + d], f[1 + d:].reshape(d, d)) for m, f in zip(models, flat.reshape(len(models), size))}


@dataclass
class Together:
    prep: Prepared
    specs: list[Spec]
    beta: np.ndarray            # models x (intercept, features)
    passes: int

    def coefficients(self, m: int) -> dict[str, float]:
        on = self.prep.active[m] > 0
        return {"intercept": float(self.beta[m, 0]), **{n: float(b) for n, b, a in zip(self.prep.names, self.beta[m, 1:], on) if a}}


def newton(table: DataFrame, prep: Prepared, specs: list[Spec], max_passes: int = 100, tol: float = 1e-9,
           start: np.ndarray | None = None) -> Together:
    """Newton steps of all models side by side, halved where the objective
    would rise; a model leaves when its step is below ``tol``. The penalty is
    |b|^2 / (2 C) without the intercept. ``start`` (models x coefficients): where
    to begin, say at models of other penalties; the objective is convex, so the
    end is the same."""
    d = 1 + prep.active.shape[1]
    ridge = np.array([[0.0] + [1.0 / s.C] * (d - 1) for s in specs])
    beta, best = np.zeros((len(specs), d)), np.full(len(specs), math.inf)
    trial, step = beta.copy() if start is None else start.copy(), np.zeros_like(beta)
    open_, passes = list(range(len(specs))), 0
    while open_ and passes < max_passes:
        passes += 1
        still = []
        for m, (loss, grad, hess) in sums_of(table, prep, trial, open_).items():
            value = loss + 0.5 * float(ridge[m] @ trial[m] ** 2)
            if value > best[m] + 1e-12 * max(abs(best[m]), 1.0):
                step[m] *= 0.5
                trial[m] = beta[m] + step[m]
                if np.abs(step[m]).max() >= tol:
                    still.append(m)
                continue
            beta[m], best[m] = trial[m], value
            a = hess + np.diag(ridge[m])
            off = np.flatnonzero(np.r_[False, prep.active[m] == 0])
            a[off, off] = 1.0
            if a[0, 0] <= 0:                                   # a model without rows
                continue
            step[m] = -np.linalg.solve(a, grad + ridge[m] * trial[m])
            trial[m] = beta[m] + step[m]
            if np.abs(step[m]).max() >= tol:
                still.append(m)
            else:
                beta[m] = trial[m]
        open_ = still
    return Together(prep, specs, beta, passes)


def fit_together(df: DataFrame, specs: list[Spec], numeric: list[str], categorical: list[str], label: str = "defaulted",
                 fold_col: str = "fold", k: int = 5, balanced: bool = True) -> Together:
    """Fit all ``specs`` on the fold-tagged, written rows of ``df``. Raises
    :class:`TooWide` beyond ``MAX_FEATURES`` features."""
    prep = prepare(df, numeric, categorical, label, fold_col, k, specs, balanced)
    table = cut_lineage(df.select(*coded(df, prep, label, fold_col)))
    return newton(table, prep, specs)


def probabilities(df: DataFrame, fitted: Together, label: str = "defaulted", fold_col: str = "fold", out: str = "probabilities") -> DataFrame:
    """``df`` with an array of every model's probability of class 1; one pass."""
    n, prep = len(df.columns), fitted.prep
    p, c = len(prep.numeric), len(prep.categorical)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` array<double>"

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, SLICE):
                z = b.slice(a, SLICE)
                _, _, x, lv = _arrays(z, n, p, c)
                prob = np.stack([1.0 / (1.0 + np.exp(-(prep.design(m, x, lv) @ fitted.beta[m]))) for m in range(len(fitted.specs))], axis=1)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(prob.ravel()), prob.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*z.columns[:n], lists], names=[*z.schema.names[:n], out])

    return df.select("*", *coded(df, prep, label, fold_col)).mapInArrow(run, ddl)
