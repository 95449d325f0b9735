"""ML-12: hyperparameter search with a density-ratio sampler and median pruning.

Trials go in rounds of ``parallel``. A round draws all its parameters from the
trials finished before, so the result depends on the seed alone. Its trials
report fold by fold, side by side; after each fold a trial whose mean so far is
below the median of what earlier trials had at the same fold is pruned."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from statistics import median

import numpy as np

#: Random trials before densities are used, candidates per draw, and trials
#: that must have reported before one is pruned.
STARTUP, CANDIDATES, WARMUP = 10, 24, 5


@dataclass(frozen=True)
class Real:
    low: float
    high: float
    log: bool = False

    def inner(self, v):
        return math.log(v) if self.log else float(v)

    def outer(self, u):
        return float(min(max(math.exp(u) if self.log else u, self.low), self.high))


@dataclass(frozen=True)
class Whole:
    low: int
    high: int

    def inner(self, v):
        return float(v)

    def outer(self, u):
        return int(min(max(round(u), self.low), self.high))


@dataclass(frozen=True)
class Choice:
    options: tuple


@dataclass
class Trial:
    number: int
    params: dict
    scores: list[float] = field(default_factory=list)      # by fold, as far as it got
    pruned: bool = False

    @property
    def mean(self) -> float:
        return sum(self.scores) / len(self.scores) if self.scores else -math.inf

    def mean_at(self, folds: int) -> float:
        return sum(self.scores[:folds]) / folds


# Search space of the tuning section (fixed values).
SPACES = {
    "logistic_regression": {"C": Real(1e-3, 1e2, log=True)},
    "boosted": {"max_depth": Whole(3, 10), "learning_rate": Real(0.01, 0.3, log=True), "n_estimators": Choice((50, 100, 200)),
                "subsample": Real(0.6, 1.0), "colsample": Real(0.6, 1.0)},
}
SPACES["boosted_leafwise"] = {**SPACES["boosted"], "max_leaves": Whole(15, 63)}


def split_trials(done: list[Trial]) -> tuple[list[Trial], list[Trial]]:
    """The best tenth (at least one, at most 25) and the others. Pruned trials
    rank below finished ones, those that got further first."""
    order = sorted(done, key=lambda t: (-len(t.scores), -t.mean, t.number))
    n = min(max(math.ceil(0.1 * len(order)), 1), 25)
    return order[:n], order[n:]


def kernel_log_density(u: np.ndarray, points: list[float], low: float, high: float) -> np.ndarray:
    """Mean of normal kernels at the points and a wide one over the whole range
    (the prior); each is normalised to the range. Widths come from the gaps to
    the neighbouring points."""
    centre = (low + high) / 2
    at = np.array(sorted(points) + [centre])
    width = _widths(at[:-1], low, high)
    mass = np.array([0.5 * (math.erf((high - m) / (s * math.sqrt(2))) - math.erf((low - m) / (s * math.sqrt(2))))
                     for m, s in zip(at, width)])
    z = (u[:, None] - at) / width
    dens = np.exp(-0.5 * z * z) / (width * math.sqrt(2 * math.pi) * mass)
    return np.log(dens.mean(axis=1) + 1e-300)


def _widths(points: np.ndarray, low: float, high: float) -> np.ndarray:
    span = (high - low) or 1.0
    ends = np.concatenate([[low], points, [high]])
    gap = np.maximum(ends[1:-1] - ends[:-2], ends[2:] - ends[1:-1]) if len(points) else np.zeros(0)
    return np.append(np.clip(gap, span / min(100.0, len(points) + 2.0), span), span)


def _draw(rng, points: list[float], low: float, high: float, n: int) -> np.ndarray:
    at = np.array(sorted(points) + [(low + high) / 2])
    width = _widths(at[:-1], low, high)
    pick = rng.integers(len(at), size=n)
    out = rng.normal(at[pick], width[pick])
    while (bad := (out < low) | (out > high)).any():
        out[bad] = rng.normal(at[pick[bad]], width[pick[bad]])
    return out


def propose(space: dict, done: list[Trial], rng: np.random.Generator, startup: int = STARTUP) -> dict:
    """Parameters of the next trial: random at first; then, one parameter after
    the other, the candidate with the highest ratio of the density of good
    trials to that of the others."""
    out = {}
    good, rest = split_trials(done) if len(done) >= startup else ([], [])
    for name, s in space.items():
        if isinstance(s, Choice):
            if not good:
                out[name] = s.options[int(rng.integers(len(s.options)))]
                continue
            share = lambda trials: np.array([1.0 + sum(t.params[name] == o for t in trials) for o in s.options])  # noqa: E731, B023
            a, b = share(good), share(rest)
            tries = rng.choice(len(s.options), size=CANDIDATES, p=a / a.sum())
            out[name] = s.options[int(tries[np.argmax(np.log(a / a.sum() / (b / b.sum()))[tries])])]
            continue
        half = 0.5 if isinstance(s, Whole) else 0.0
        low, high = s.inner(s.low) - half, s.inner(s.high) + half
        if not good:
            out[name] = s.outer(float(rng.uniform(low, high)))
            continue
        at = [s.inner(t.params[name]) for t in good], [s.inner(t.params[name]) for t in rest]
        u = _draw(rng, at[0], low, high, CANDIDATES)
        ratio = kernel_log_density(u, at[0], low, high) - kernel_log_density(u, at[1], low, high)
        out[name] = s.outer(float(u[int(ratio.argmax())]))
    return out


def falls_behind(trial: Trial, earlier: list[Trial], warmup: int = WARMUP) -> bool:
    """Whether the trial's mean over its folds is below the median of the means
    that earlier trials had after as many folds."""
    n = len(trial.scores)
    there = [t.mean_at(n) for t in earlier if len(t.scores) >= n]
    return len(there) >= warmup and trial.mean < median(there)


def search(space: dict, score: Callable[[list[dict], int], list[float]], folds: int, n_trials: int = 100, parallel: int = 4,
           seed: int = 42, startup: int = STARTUP, warmup: int = WARMUP) -> list[Trial]:
    """All trials in order. ``score(params of some trials, fold)`` returns their
    scores on that fold; trials of a round are passed together."""
    done: list[Trial] = []
    while len(done) < n_trials:
        some = range(len(done), min(len(done) + parallel, n_trials))
        now = [Trial(i, propose(space, done, np.random.default_rng([seed, i]), startup)) for i in some]
        for fold in range(folds):
            alive = [t for t in now if not t.pruned]
            if not alive:
                break
            for t, v in zip(alive, score([t.params for t in alive], fold)):
                t.scores.append(float(v))
            if fold + 1 < folds:
                for t in alive:
                    t.pruned = falls_behind(t, done, warmup)
        done += now
    return done


def best_trial(trials: list[Trial]) -> Trial | None:
    """The finished trial of the highest mean; ties go to the earlier one."""
    return min((t for t in trials if not t.pruned and t.scores), key=lambda t: (-t.mean, t.number), default=None)
