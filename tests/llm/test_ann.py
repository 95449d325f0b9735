import numpy as np
from pyspark.sql import functions as F
from riskframe.llm import ann


def table(spark, rows):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    return d.withColumn("v", F.lit(1)).withColumn("list", F.lit("x")).withColumn("ask", F.lit(True))


def brute(rows, k):
    """The exact answer; identical scores go to the smaller id."""
    ids = np.array([r[0] for r in rows])
    x = np.array([np.float32(r[1]).astype(float) for r in rows])
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def answers(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def clustered(n, seed=0, dim=24, norms=False):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, dim))
    if norms:
        x *= rng.uniform(0.2, 3, n)[:, None]
    return [(i, x[i].astype(np.float32).tolist(), 0) for i in range(n)]


def test_recall(spark):
    for norms in (False, True):
        rows = clustered(3000, norms=norms)
        want, got = brute(rows, 20), answers(ann.nearest(table(spark, rows)))
        assert got.keys() == want.keys()
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits >= 0.9 * 20 * len(want)
        exact = {r[0]: np.float32(r[1]).astype(float) for r in rows}
        for q, found in got.items():
            assert len(found) == 20
            assert all(abs(s - float((exact[q] * exact[i]).sum())) < 1e-9 for i, s in found)


def test_all_lists_probed_is_exact_with_copies_and_small_blocks(spark):
    """A third of the rows are copies of one vector: ties to the smaller id."""
    rows = clustered(600, seed=3, dim=8)
    rows = [(i, rows[7][1] if i % 3 == 0 else v, 0) for i, v, _ in rows]
    got = answers(ann.nearest(table(spark, rows), target=1, block=64))
    want = brute(rows, 20)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_rows_that_take_no_part(spark):
    good = [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (20, [0.0, 2.0], 0), (3, [1.0, 0.0], 0), (3, [1.0, 0.0], 0)]
    bad = [(40, None, 0), (60, [0.0, 0.0], 0), (80, [float("nan"), 1.0], 0), (100, [None, 1.0], 0),
           (120, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0), (140, [1.0, 2.0, 3.0], 0), (160, [], 0)]
    got = answers(ann.nearest(table(spark, good + bad)))
    assert got == {0: [(3, 1.0), (1, 0.5), (20, 0.0)], 20: [(1, 1.0), (0, 0.0), (3, 0.0)]}


def test_empty_and_single(spark):
    assert ann.nearest(table(spark, [])).count() == 0
    assert ann.nearest(table(spark, [(0, [1.0, 2.0], 0)])).count() == 0


def test_recall_without_clusters(spark):
    """Random directions: many lists must be probed."""
    rng = np.random.default_rng(5)
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(rng.standard_normal((4000, 48)))]
    want, got = brute(rows, 20), answers(ann.nearest(table(spark, rows), sample=1000, block=500))
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_scan_abandons_early_and_keeps_the_nearest():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((4000, 64))
    q, _ = np.linalg.qr(rng.standard_normal((64, 64)))
    y = base @ q
    z = y[[17, 18]] + 0.05 * rng.standard_normal((2, 64))
    blocks = [np.ascontiguousarray(y[:, c:c + 16]) for c in range(0, 64, 16)]
    exact = ((y[None] - z[:, None]) ** 2).sum(-1)
    limit = np.sort(exact, axis=1)[:, 9]
    allowed = np.ones((2, 4000), dtype=bool)
    allowed[1, ::2] = False
    queries, rows = ann.scan(blocks, z, limit, allowed)
    for i in (0, 1):
        kept = set(rows[queries == i].tolist())
        near = {j for j in np.flatnonzero(exact[i] <= limit[i]).tolist() if allowed[i, j]}
        assert kept == near and all(allowed[i, list(kept)])


def test_small_lists_share_bins():
    assert ann.binned(np.array([3, 0, 2, 9, 1, 1]), 5).tolist() == [0, 0, 0, 1, 2, 2]


def test_rows_come_from_the_probed_lists_only(spark):
    """The sample is the whole table; one list of a target of nearly nothing is
    still all that a query may answer from."""
    rows = clustered(2000, seed=9)
    df = table(spark, rows)
    index, _ = ann.fit_index(ann.valid_vectors(df))
    x = np.array([np.float32(r[1]).astype(float) for r in rows])
    home = index.by_distance(index.rotated(x)).argmin(axis=1)
    order = index.by_distance(index.rotated(x, query=True)).argsort(axis=1, kind="stable")
    sizes = np.bincount(home, minlength=len(index.centroids))
    got = answers(ann.nearest(df, target=1e-9))
    assert len(got) == 100
    for q, found in got.items():
        need = max(int((np.cumsum(sizes[order[q]]) < 4 * 21).sum()) + 1, 1)
        assert len(found) == 20 and {home[i] for i, _ in found} <= set(order[q][:need].tolist())


def test_lists_alone_recall_with_a_small_sample(spark):
    """A sample of a twentieth of the table: thresholds and probes come from it,
    rows from the lists."""
    for norms in (False, True):
        rows = clustered(6000, seed=11, norms=norms)
        want, got = brute(rows, 20), answers(ann.nearest(table(spark, rows), sample=300))
        assert all(len(found) == 20 for found in got.values())
        assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_repeated_ids_with_different_vectors_are_one_item(spark):
    rows = [(0, [1.0, 0.0], 0), (5, [0.9, 0.1], 0), (5, [0.2, 0.9], 0), (7, [0.5, 0.5], 0), (0, [1.0, 0.5], 0)]
    assert answers(ann.nearest(table(spark, rows))) == {0: [(7, 0.5), (5, float(np.float32(0.2)))]}


def test_many_lists(spark, monkeypatch):
    """As many lists as a large table gets; every vector is still found."""
    monkeypatch.setattr(ann, "LISTS", (4096, 4096))
    rows = clustered(6000, seed=21, dim=12)
    index, n = ann.fit_index(ann.valid_vectors(table(spark, rows)))
    assert n == 6000 and len(index.centroids) == 4096
    want, got = brute(rows, 20), answers(ann.nearest(table(spark, rows)))
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
