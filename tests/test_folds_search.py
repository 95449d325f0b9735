"""ML-8 / ML-12: folds fitted together equal separate fits; the search."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from riskframe.operators import folds as FO
from riskframe.operators import search as SE
from riskframe.operators import training as T
from riskframe.sources import fixtures as X
from riskframe.session import cut_lineage

NUM, CAT = ["Age", "Income", "LoanAmount"], ["Gender", "Education"]


@pytest.fixture(scope="module")
def tagged(spark, sf):
    """NULLs in both kinds of columns, and a level that one fold alone has."""
    d = X.scored(spark, sf).withColumn("fold", F.pmod(F.col("app_id"), F.lit(3)).cast("int"))
    d = d.withColumn("Income", F.when(F.col("app_id") % 7 != 0, F.col("Income"))) \
        .withColumn("Gender", F.when(F.col("app_id") % 11 != 0, F.col("Gender"))) \
        .withColumn("Education", F.when((F.col("fold") == 1) & (F.col("app_id") % 5 == 0), "AAA").otherwise(F.col("Education")))
    return cut_lineage(d)


@pytest.mark.parametrize("balanced", [True, False])
def test_equal_to_separate_fits(tagged, balanced):
    specs = [FO.Spec(i) for i in range(3)] + [FO.Spec(None, 0.01)]
    got = FO.fit_together(tagged, specs, NUM, CAT, k=3, balanced=balanced)
    assert got.passes < 15
    probs = FO.probabilities(tagged, got).select("app_id", "probabilities").toPandas().set_index("app_id").probabilities
    for m, s in enumerate(specs):
        train = tagged if s.fold is None else tagged.where(F.col("fold") != s.fold)
        one = T.fit_model(train, "logistic_regression", NUM, CAT, balanced=balanced, params={"C": s.C, "tol": 1e-12})
        want = dict(zip(one.prep.feature_names, one.model.coefficients.toArray())) | {"intercept": one.model.intercept}
        mine = got.coefficients(m)
        assert set(mine) == set(want)
        for name, v in want.items():
            assert mine[name] == pytest.approx(v, abs=1e-6), (s, name)
        score = one.score(tagged).select("app_id", "probability_default").toPandas().set_index("app_id").probability_default
        gap = max(abs(probs[i][m] - score[i]) for i in score.index)
        assert gap < 1e-6


def test_passes_do_not_grow_with_models(tagged):
    few = FO.fit_together(tagged, [FO.Spec(0)], NUM, CAT, k=3)
    many = FO.fit_together(tagged, [FO.Spec(i, c) for i in range(3) for c in (0.1, 1.0, 10.0)], NUM, CAT, k=3)
    assert many.passes <= few.passes + 2


def test_too_wide_and_empty(spark, tagged, monkeypatch):
    monkeypatch.setattr(FO, "MAX_FEATURES", 4)
    with pytest.raises(FO.TooWide):
        FO.fit_together(tagged, [FO.Spec(0)], NUM, CAT, k=3)
    monkeypatch.undo()
    none = FO.fit_together(tagged.limit(0), [FO.Spec(0)], NUM, CAT, k=3)
    assert (none.beta == 0).all()


def quadratic(params, fold):
    return [1.0 - (math.log10(p["C"]) - 0.5) ** 2 / 10 - 0.01 * fold for p in params]


def test_search_is_deterministic_and_prunes():
    space = SE.SPACES["logistic_regression"]
    a = SE.search(space, quadratic, 5, n_trials=24, seed=3)
    b = SE.search(space, quadratic, 5, n_trials=24, seed=3)
    assert a == b and [t.number for t in a] == list(range(24))
    assert any(t.pruned for t in a) and all(len(t.scores) == 5 for t in a if not t.pruned)
    late = [abs(math.log10(t.params["C"]) - 0.5) for t in a[12:]]
    early = [abs(math.log10(t.params["C"]) - 0.5) for t in a[:10]]
    assert np.mean(late) < np.mean(early)                 # it searches where it was good
    assert SE.best_trial(a).mean == max(t.mean for t in a if not t.pruned)
    # pruning, again from the recorded scores
    for t in a:
        before = [u for u in a if u.number // 4 < t.number // 4]
        for n in range(1, len(t.scores)):
            there = sorted(sum(u.scores[:n]) / n for u in before if len(u.scores) >= n)
            if len(there) >= 5:
                mid = (there[(len(there) - 1) // 2] + there[len(there) // 2]) / 2
                assert sum(t.scores[:n]) / n >= mid
        if t.pruned:
            there = sorted(u.mean_at(len(t.scores)) for u in before if len(u.scores) >= len(t.scores))
            assert t.mean < (there[(len(there) - 1) // 2] + there[len(there) // 2]) / 2


def test_proposal_is_the_best_ratio():
    """The sampler's choice, recomputed plainly from the same draws."""
    space = {"x": SE.Real(0.0, 1.0)}
    done = [SE.Trial(i, {"x": i / 19}, [-(i / 19 - 0.3) ** 2]) for i in range(20)]
    got = SE.propose(space, done, np.random.default_rng(5))
    good, rest = SE.split_trials(done)
    assert [t.number for t in good] == [6, 5]
    draws = SE._draw(np.random.default_rng(5), [t.params["x"] for t in good], 0.0, 1.0, SE.CANDIDATES)

    def density(u, points):
        points = sorted(points)
        total = 0.0
        for j, c in enumerate([*points, 0.5]):
            if j < len(points):
                lower, upper = points[j - 1] if j else 0.0, points[j + 1] if j + 1 < len(points) else 1.0
                s = min(max(c - lower, upper - c, 1 / min(100, len(points) + 2)), 1.0)
            else:
                s = 1.0
            cdf = lambda v: 0.5 * (1 + math.erf((v - c) / (s * math.sqrt(2))))  # noqa: E731, B023
            total += math.exp(-0.5 * ((u - c) / s) ** 2) / (s * math.sqrt(2 * math.pi)) / (cdf(1.0) - cdf(0.0))
        return total / (len(points) + 1)

    ratio = [density(u, [t.params["x"] for t in good]) / density(u, [t.params["x"] for t in rest]) for u in draws]
    assert got["x"] == draws[int(np.argmax(ratio))]
    kinds = {"c": SE.Choice(("a", "b")), "n": SE.Whole(3, 9)}
    done = [SE.Trial(i, {"c": "ab"[i % 2], "n": 3 + i % 7}, [float(i % 2)]) for i in range(40)]
    seen = [SE.propose(kinds, done, np.random.default_rng(i)) for i in range(30)]
    assert sum(p["c"] == "b" for p in seen) > 20 and all(3 <= p["n"] <= 9 for p in seen)


def test_search_over_models(spark, tagged):
    """Logistic trials share passes; boosted ones run side by side. Scores are
    those of separate fits."""
    r = T.hyper_search(tagged, "logistic_regression", NUM, CAT, n_trials=3, k=3, parallel=2).collect()
    assert [t.trial for t in r] == [0, 1, 2] and all(t.folds == 3 and t.state == "complete" for t in r)
    c = eval(r[1].params)["C"]
    one = T.fit_model(tagged.where("fold <> 2"), "logistic_regression", NUM, CAT, params={"C": c, "tol": 1e-12})
    from riskframe.operators.evaluation import auc_by
    s = one.score(tagged.where("fold = 2"))
    assert r[1].fold_roc_auc[2] == pytest.approx(auc_by(s, "fold", "defaulted", "probability_default")[2], abs=1e-4)
    space = {"learning_rate": SE.Real(0.1, 0.5, log=True), "n_estimators": SE.Choice((1, 2)), "max_leaves": SE.Whole(3, 5)}
    b = T.hyper_search(tagged.where("fold < 2"), "boosted_leafwise", ["Age", "CreditScore"], [], n_trials=2, k=2, space=space).collect()
    assert len(b) == 2 and all(0.6 < v <= 1 for t in b for v in t.fold_roc_auc)
    with pytest.raises(ValueError):
        T.hyper_search(tagged, "logistic_regression", NUM, CAT, sampler="grid")
