import random
import re

import numpy as np
import pytest
import xxhash
from helpers_llm import EDGE, edge_docs, empty_docs
from riskframe.llm import simhash


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(prints, bits):
    parent = {p: p for p in prints}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in parent:
        for b in parent:
            if a < b and (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {p: find(p) for p in parent}


def expected(rows, bits=2):
    prints = [(i, brute_print(t)) for i, t, *_ in rows]
    root = brute_roots({p for _, p in prints}, bits)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted(str((i, f"{p:016x}", least.get(root[p]))) for i, p in prints)


def near_copies(n=150, seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    while len(rows) < n:
        words = [rng.choice(vocab) for _ in range(rng.randint(40, 200))]
        for _ in range(rng.randint(1, 6)):
            w = list(words)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w), "en"))
    return rows


def test_edge_rows(spark):
    got = simhash.simhash_components(edge_docs(spark)).collect()
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == expected(EDGE)


def test_near_copies(spark):
    rows = near_copies()
    want = expected(rows)
    assert len({w.split(",")[2] for w in want}) < len(rows) - 20
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want


def test_empty_table(spark):
    assert simhash.simhash_components(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("bits,segments", [(2, 8), (1, 4), (3, 8), (2, 16), (0, 8)])
def test_links_join_all_that_are_linked(spark, bits, segments):
    """A cloud of many prints around few centres: long runs are dealt out again."""
    rng = random.Random(bits * 100 + segments)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(200):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
            prints.add(x)
    for _ in range(500):                       # many in one long run
        prints.add(0x123456 << 40 | rng.getrandbits(18))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    df = spark.createDataFrame(signed, "fp long")
    links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(df, bits=bits, segments=segments).collect()]
    assert all((a ^ b).bit_count() <= bits and a != b for a, b in links)
    parent = {p: p for p in prints}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {p: find(p) for p in prints} == brute_roots(prints, bits)


def test_long_text_in_blocks_is_the_same(monkeypatch):
    text = " ".join(f"T{i * 7919 % 5000}" for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_BLOCK", 100)
    assert simhash.fingerprint(text) == whole == brute_print(text)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(-5, 300), (300, 200), (7, 7)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {-5: -5, 300: -5, 200: -5}
    assert got == want


def test_pigeonring_prunes_only_what_is_too_far():
    rng = np.random.default_rng(0)
    rings = simhash.ring_masks(list(range(64)), 8, 2)
    for d in range(0, 4):
        for _ in range(200):
            x = np.uint64(sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
            any_ring = any(bool(simhash._within(np.array([x]), c, 2)[0]) for c in rings)
            assert any_ring == (d <= 2)
