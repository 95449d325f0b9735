"""ML-5/6, ML-14, SC-6: leaf-wise trees against a small in-memory version,
early stopping against scoring every round, contributions against all subsets."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from riskframe.operators import boosting as B
from riskframe.operators.evaluation import ranking_metrics

P = B.TreeParams(n_estimators=4, max_leaves=9, max_depth=5, min_rows=3, max_bins=16, l1=0.1, subsample=0.8, colsample=0.7)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        a, b, c, d = rng.normal(), float(rng.integers(0, 5)), rng.random(), float(rng.random() < 0.05)
        z = a * (b > 2) - 2 * (c > .6) + d + rng.normal() * .5
        rows.append((i, float(a) if i % 17 else None, b, float(c), d, 1.0 + (i % 3), int(z > 0)))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, w double, y int").repartition(6)
    df = df.cache()
    df.count()
    return df


FEATURES = ["a", "b", "c", "d"]


def in_memory(model, bins, rid, y, w):
    """The same boosting on arrays: one split at a time, every histogram anew."""
    p = model.params
    margin = np.full(len(y), model.start)
    trees = []
    for number in range(p.n_estimators):
        rng = np.random.default_rng([p.seed, number])
        feats = sorted(rng.permutation(bins.shape[1])[:max(1, math.ceil(p.colsample * bins.shape[1]))].tolist())
        prob = 1 / (1 + np.exp(-margin))
        g, h = np.rint((prob - y) * w * B.UNIT), np.rint(prob * (1 - prob) * w * B.UNIT)
        use = B.sampled(rid, number, p)
        node = np.ones(len(y), dtype=int)
        shrink = lambda x: math.copysign(max(abs(x) - p.l1, 0), x)
        score = lambda m: shrink(g[m].sum() / B.UNIT) ** 2 / (h[m].sum() / B.UNIT + p.l2)

        def best(n):
            out = (1e-12, None, None)
            if n.bit_length() > p.max_depth:
                return out
            m = use & (node == n)
            for f in feats:
                for cut in range(p.max_bins - 1):
                    l, r = m & (bins[:, f] <= cut), m & (bins[:, f] > cut)
                    if min(l.sum(), r.sum()) < p.min_rows or min(h[l].sum(), h[r].sum()) / B.UNIT < p.min_hessian:
                        continue
                    gain = score(l) + score(r) - score(m)
                    if gain > out[0] + 1e-9:
                        out = (gain, f, cut)
            return out

        able, splits = {1: best(1)}, []
        while len(able) < p.max_leaves:
            n = min(able, key=lambda n: (-able[n][0], n))
            gain, f, cut = able.pop(n)
            if f is None:
                able[n] = (gain, f, cut)
                break
            splits.append((n, f, cut, gain))
            node[(node == n) & (bins[:, f] <= cut)] = 2 * n
            node[node == n] = 2 * n + 1
            able |= {2 * n: best(2 * n), 2 * n + 1: best(2 * n + 1)}
        value = {n: -shrink(g[use & (node == n)].sum() / B.UNIT) / (h[use & (node == n)].sum() / B.UNIT + p.l2) * p.learning_rate for n in able}
        margin = margin + np.array([value[n] for n in node])
        trees.append((splits, value))
    return trees


def test_trees_match_the_in_memory_version(spark, data):
    model = B.fit_boosted(data, FEATURES, "y", "id", P, weight="w")
    rows = data.select(F.xxhash64("id").alias("rid"), "w", "y", *FEATURES).toPandas()
    bins = model.bins_of([rows[c].to_numpy(dtype=float) for c in FEATURES])
    want = in_memory(model, bins, rows.rid.to_numpy(), rows.y.to_numpy(dtype=float), rows.w.to_numpy())
    assert len(model.trees) == 4
    for t, (splits, value) in zip(model.trees, want):
        got = {int(n): (int(f), int(c), g) for n, f, c, g in zip(t.heap, t.feature, t.cut, t.gain) if f >= 0}
        assert set(got) == {s[0] for s in splits} and t.leaves() == len(splits) + 1 <= 9
        for n, f, cut, gain in splits:
            assert got[n][:2] == (f, cut) and got[n][2] == pytest.approx(gain)
        assert {int(n): v for n, v, f in zip(t.heap, t.value, t.feature) if f < 0} == pytest.approx(value)
    table = B.trees_table(spark, model)
    assert table.where("value IS NOT NULL").count() == sum(t.leaves() for t in model.trees)


def test_same_trees_however_rows_are_dealt(data):
    a = B.fit_boosted(data, FEATURES, "y", "id", P)
    b = B.fit_boosted(data.repartition(2, "c"), FEATURES, "y", "id", P)
    for s, t in zip(a.trees, b.trees):
        assert (s.heap == t.heap).all() and (s.feature == t.feature).all() and (s.cut == t.cut).all()
        assert s.value == pytest.approx(t.value, abs=1e-6)


def test_resume_equals_one_fit(data, monkeypatch):
    monkeypatch.setattr(B, "COMMIT", 2)
    whole = B.fit_boosted(data, FEATURES, "y", "id", P)
    part = B.fit_boosted(data, FEATURES, "y", "id", B.replace(P, n_estimators=3))
    more = B.fit_boosted(data, FEATURES, "y", "id", P, resume=part)
    assert len(part.trees) == 3 and len(more.trees) == 4
    for s, t in zip(whole.trees, more.trees):
        assert (s.heap == t.heap).all() and s.value == pytest.approx(t.value, abs=1e-6)


def test_stops_where_scoring_every_round_would(data, monkeypatch):
    monkeypatch.setattr(B, "COMMIT", 4)
    p = B.replace(P, n_estimators=16, learning_rate=0.8)
    train, held = data.where("id % 3 > 0"), data.where("id % 3 = 0")
    model = B.fit_boosted(train, FEATURES, "y", "id", p, validation=held, patience=3)
    full = B.fit_boosted(train, FEATURES, "y", "id", p)
    aucs = []
    for r in range(1, len(model.history) + 1):
        cut = B.replace(full, trees=full.trees[:r])
        s = B.score_boosted(held, cut)
        aucs.append(ranking_metrics(s, "y", "probability_default").first()["roc_auc"])
    assert [a for _, a in model.history] == pytest.approx(aucs)
    best = 0
    for r, a in enumerate(aucs, 1):
        if best == 0 or a > aucs[best - 1]:
            best = r
        elif r - best >= 3:
            break
    assert len(model.trees) == best < 16
    assert B.stop_round([(1, .5), (2, .6), (3, .6), (4, .55)], 3) is None
    assert B.stop_round([(1, .5), (2, .6), (3, .6), (4, .55), (5, .6)], 3) == 2


def expectation(tree, x, known):
    """Expected value with the features in ``known`` given."""
    def go(i):
        f = tree.feature[i]
        if f < 0:
            return tree.value[i]
        l, r = tree.left[i], tree.right[i]
        if f in known:
            return go(l) if x[f] <= tree.cut[i] else go(r)
        return (tree.cover[l] * go(l) + tree.cover[r] * go(r)) / tree.cover[i]
    return go(0)


def test_contributions_equal_all_subsets(spark, data):
    model = B.fit_boosted(data.withColumn("e", F.col("c") * F.col("b")), [*FEATURES, "e"], "y", "id",
                          B.replace(P, n_estimators=3, max_leaves=16, colsample=1.0))
    x = data.withColumn("e", F.col("c") * F.col("b")).where("id < 25")
    got = {r.id: r for r in B.tree_contributions(x, model, ["id"]).collect()}
    score = {r.id: r.probability_default for r in B.score_boosted(x, model).collect()}
    rows = x.select("id", *model.features).toPandas()
    bins = model.bins_of([rows[c].to_numpy(dtype=float) for c in model.features])
    n = len(model.features)
    for key, b in zip(rows.id, bins):
        value = {s: sum(expectation(t, b, s) for t in model.trees) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
        r = got[key]
        assert r.base_value == pytest.approx(model.start + value[()])
        for f, c in enumerate(r.contributions):
            want = sum(math.factorial(len(s)) * math.factorial(n - 1 - len(s)) / math.factorial(n)
                       * (value[tuple(sorted((*s, f)))] - value[s]) for s in value if f not in s)
            assert c.feature == model.features[f] and c.value == pytest.approx(want, abs=1e-12)
        assert r.base_value + sum(c.value for c in r.contributions) == pytest.approx(r.margin, abs=1e-10)
        assert 1 / (1 + math.exp(-r.margin)) == pytest.approx(score[key])
    top = B.top_contributions(B.tree_contributions(x, model, ["id"]), 2).first().contributions
    assert len(top) == 2 and abs(top[0].value) >= abs(top[1].value)


def test_long_paths_without_tables(monkeypatch, data):
    model = B.fit_boosted(data, FEATURES, "y", "id", P)
    bins = np.random.default_rng(0).integers(0, 16, (50, 4)).astype(np.uint8)
    a = B.Explainer(model).contributions(bins)
    monkeypatch.setattr(B, "TABLED", 0)
    assert B.Explainer(model).contributions(bins) == pytest.approx(a)


def test_degenerate_inputs(spark, data):
    for df in (data.limit(0), data.where("y = 1"), data.where("id = 3")):
        model = B.fit_boosted(df, FEATURES, "y", "id", B.replace(P, n_estimators=2))
        assert all(t.leaves() == 1 for t in model.trees)
        assert B.tree_contributions(data.where("id < 5"), model, ["id"]).count() == 5
    flat = data.select("id", "y", F.lit(1.0).alias("k"), F.lit(None).cast("double").alias("none"))
    model = B.fit_boosted(flat, ["k", "none"], "y", "id", B.replace(P, n_estimators=1))
    assert model.trees[0].leaves() == 1
