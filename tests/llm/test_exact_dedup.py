import hashlib
import random
import re
from collections import defaultdict

from helpers_llm import EDGE, edge_docs, empty_docs
from riskframe.llm.exact_dedup import PatriciaTrie, exact_dedup, trie_owners


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    return groups


def test_edge_rows_match_brute_force(spark):
    got = exact_dedup(edge_docs(spark)).collect()
    assert len(got) == len(EDGE)
    groups = brute(EDGE)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): ids for k, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.keep_id == min(i for i in ids if i is not None)
        assert r.group_size == len(ids)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}          # also where rows repeat


def test_empty_table(spark):
    df = exact_dedup(empty_docs(spark))
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and df.count() == 0


def test_trie_against_dict_with_and_without_spill():
    rng = random.Random(3)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    want = {}
    for i, w in enumerate(words):
        low, n = want.get(w, (i, 0))
        want[w] = (min(low, i), n + 1)
    for budget in (1 << 30, 40_000, 2_000):
        got = {k: v[:2] for k, v in trie_owners(((w, (i, 1, None)) for i, w in enumerate(words)), budget)}
        assert got == want, budget


def test_trie_prefixes_and_empty_key():
    t = PatriciaTrie()
    for k, i in ((b"", 4), (b"abc", 3), (b"ab", 2), (b"abd", 9), (b"ab", 1), (b"", None)):
        t.insert(k, (i, 1, None))
    assert sorted((k, v[:2]) for k, v in t.entries()) == [(b"", (4, 2)), (b"ab", (1, 2)), (b"abc", (3, 1)), (b"abd", (9, 1))]
