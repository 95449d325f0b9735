import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from helpers_llm import EDGE, edge_docs, empty_docs, rows_of
from riskframe.llm import periodic


def brute_runs(x):
    """All runs by trying every period from every place."""
    found = {}
    n = len(x)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def random_words(rng, kind):
    n = rng.choice([0, 1, 5, 6, 30, 200, 900])
    x = [b"%d" % rng.randrange(2 if kind % 2 else 400) for _ in range(n)]
    for _ in range(kind % 4):
        q, times, at = rng.randrange(1, 120), rng.randrange(2, 9), rng.randrange(n + 1)
        unit = [b"%d" % rng.randrange(rng.choice([2, 3, 500])) for _ in range(q)]
        x[at:at] = (unit * times)[:q * times - rng.randrange(q)]
    return x


def test_matches_brute_force():
    rng = random.Random(5)
    for _ in range(30):
        texts = [random_words(rng, k) for k in range(6)]
        for t, got in zip(texts, periodic.runs_of_texts(texts)):
            assert [tuple(r) for r in got.tolist()] == brute_runs(t)


def test_every_period_around_the_scales():
    """A run of exactly 4 q words, the shortest there is, at every period."""
    for q in [1, 2, 15, 16, 17, 31, 32, 33, 63, 64, 127, 128, 255, 256, 300]:
        x = [b"l%d" % i for i in range(7)] + [b"w%d" % (i % q) for i in range(periodic.long_enough(q))] + [b"r"]
        (got,) = periodic.runs_of_texts([x])
        assert got.tolist() == [[7, periodic.long_enough(q), q]]
        short = x[:7] + x[8:]
        assert periodic.runs_of_texts([short])[0].tolist() == [], q


def test_smallest_period_and_ties():
    x = [b"a", b"b"] * 40                                  # also has the periods 4, 6, ..., 16, 32
    assert periodic.runs_of_texts([x])[0].tolist() == [[0, 80, 2]]
    assert periodic.greatest(np.array([[9, 12, 3], [4, 8, 2], [30, 16, 4]])) == (4, 8, 2)
    assert periodic.greatest(np.zeros((0, 3), dtype=int)) is None


def want(doc, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    drop = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join("%d,%d,%d\n" % r for r in runs).encode()),
            sha(b" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000")
    got = sorted(rows_of(periodic.run_digests(docs)))
    assert got == sorted(want(r.doc_id, r.text) for r in docs.collect())
    assert sum(r[1] > 0 for r in got) > 10


def test_edge_rows(spark):
    short = [r for r in EDGE if len(r[1] or "") < 10_000] + [(20, "z " * 9000, "en")]
    got = [r for r in rows_of(periodic.run_digests(edge_docs(spark, short))) if r[0] != 20]
    assert sorted(got, key=str) == sorted((want(d, t) for d, t, _ in short if d != 20), key=str)
    plain = {r.doc_id: r for r in periodic.periodic_runs(edge_docs(spark, EDGE + [(20, "z " * 9000, "en")])).collect()}
    assert plain[20].runs == [[0, 9000, 1]] and plain[20].text == "z"
    assert plain[3].n_words == 0 and plain[3].text == "" and plain[3].runs == []
    assert plain[11].n_words == 30_000 and [r[2] for r in plain[11].runs] == [997]
    assert rows_of(periodic.run_digests(empty_docs(spark))) == []
