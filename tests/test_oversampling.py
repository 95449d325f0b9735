"""ML-13: exact neighbours against brute force, seeded interpolation."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from riskframe.operators import oversampling as O


def brute(rows, k):
    """(key, rank, neighbour) by comparing all pairs."""
    keys = [r[0] for r in rows]
    x = np.array([r[1:] for r in rows], dtype=float).reshape(len(rows), -1)
    out = []
    for i, key in enumerate(keys):
        gap = sum((x[:, j] - x[i, j]) ** 2 for j in range(x.shape[1]))
        order = sorted((g, k2) for g, k2 in zip(gap.tolist(), keys) if k2 != key)[:k]
        out += [(key, r + 1, n) for r, (_, n) in enumerate(order)]
    return sorted(out)


def found(df, k=5, cols=("a", "b", "c")):
    return sorted((r["id"], r["rank"], r["neighbour"]) for r in O.nearest_neighbours(df, "id", list(cols), k).collect())


@pytest.mark.parametrize("kind", ["uniform", "clusters", "copies", "grid", "line"])
def test_neighbours_are_exact(spark, kind, monkeypatch):
    """Small bins, so that cells are cut by slices and by hash."""
    monkeypatch.setattr(O, "BIN_ROWS", 25)
    monkeypatch.setattr(O, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    n = 700
    x = {"uniform": lambda: rng.random((n, 3)),
         "clusters": lambda: rng.integers(0, 4, (n, 1)) * 10 + rng.normal(size=(n, 3)) * [1, .1, .01],
         "copies": lambda: np.where(rng.random((n, 1)) < .5, 7.0, rng.random((n, 3))),         # half the rows are one point
         "grid": lambda: rng.integers(0, 6, (n, 3)).astype(float),                             # many ties
         "line": lambda: np.stack([np.arange(n) ** 2.0, np.zeros(n), -0.0 * np.ones(n)], 1)}[kind]()
    rows = [(int(i) * 3 + 1, *map(float, v)) for i, v in zip(rng.permutation(n), x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5)
    assert found(df) == brute(rows, 5)


def test_neighbours_edge_rows(spark):
    schema = "id long, a double, b double, c double"
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0., 0., 0.), (2, 0., 0., 0.), (3, None, 0., 0.), (4, nan, 0., 0.), (5, inf, 0., 0.), (6, 1., 0., 0.)]
    df = spark.createDataFrame(rows, schema)
    assert found(df) == [(1, 1, 2), (1, 2, 6), (2, 1, 1), (2, 2, 6), (6, 1, 1), (6, 2, 2)]
    assert found(df.where("id = 1")) == [] and found(df.limit(0)) == []


def test_oversample(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 4 == 0), float(rng.random()), float(rng.integers(0, 50)), "u" if i % 3 else None) for i in range(400)]
    rows += [(1000, 1, None, 3.0, "v"), (1001, None, 0.5, 0.5, "w")]
    df = spark.createDataFrame(rows, "id long, y int, p double, q double, g string")
    out = O.oversample_minority(df, "y", "id", ["p", "q"]).collect()
    old, new = [r for r in out if not r.synthetic], [r for r in out if r.synthetic]
    assert sorted((r.id, r.y, r.p, r.q, r.g) for r in old) == sorted(rows)
    assert sum(r.y == 1 for r in out) == sum(r.y == 0 for r in out) == 300 and len(new) == 300 - 101
    small = [(i, p, q) for i, y, p, q, _ in rows if y == 1 and p is not None]
    lo, hi = np.min([r[1:] for r in small], 0), np.max([r[1:] for r in small], 0)
    near = {}
    for key, rank, n in brute([(i, (p - lo[0]) / (hi[0] - lo[0]), (q - lo[1]) / (hi[1] - lo[1])) for i, p, q in small], 5):
        near.setdefault(key, []).append(n)
    at = {i: (p, q, g) for i, _, p, q, g in rows}
    times = {}
    for r in new:
        assert r.id is None and r.y == 1 and r.g == at[r.base][2]
        copy = times.setdefault(r.base, [])
        copy.append(r)
    want = set()
    for base, rs in times.items():
        for c in range(len(rs)):
            h = hashlib.md5(f"{base}|{c}|42".encode()).hexdigest()
            n, share = near[base][int(h[:8], 16) % 5], int(h[8:16], 16) / 2**32
            want.add((base, n, share, *[at[base][j] + share * (at[n][j] - at[base][j]) for j in (0, 1)]))
    assert {(r.base, r.neighbour, r.share, r.p, r.q) for r in new} == want
    counts = sorted(map(len, times.values()))
    assert len(times) == 100 and counts[0] >= 1 and counts[-1] <= 2          # the row with a NULL is no base


def test_oversample_edges(spark):
    schema = "id long, y int, p double"
    one = spark.createDataFrame([(i, int(i == 0), float(i)) for i in range(4)], schema)
    got = O.oversample_minority(one, "y", "id", ["p"]).where("synthetic").collect()
    assert [(r.base, r.neighbour, r.p) for r in got] == [(0, None, 0.0)] * 2      # a lone row is copied
    assert O.oversample_minority(one.where("y = 0"), "y", "id", ["p"]).count() == 3
    assert O.oversample_minority(one.limit(0), "y", "id", ["p"]).count() == 0
    with pytest.raises(ValueError):
        O.oversample_minority(one.withColumn("y", F.col("id").cast("int")), "y", "id", ["p"])
