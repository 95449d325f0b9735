import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers_llm import EDGE, LONG, edge_docs, empty_docs, rows_of
from riskframe.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(docs, slips):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if slips and doc is not None and h % 97 == 0:
                i = h % len(w)
                w = w[:i] + w[i + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def brute(docs, slips=True):
    """Near words by comparing all words of one length or the next."""
    n = brute_words(docs, slips)
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    near, form = {}, {}
    for w in n:
        near[w] = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if is_near(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=str)


def grouped(df, **options):
    return sorted(rows_of(spelling.spelling_groups(df, **options)), key=str)


def test_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert grouped(docs, slips=True) == brute([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("round_blocks", [spelling.ROUND_BLOCKS, 3])
def test_dense_neighbourhoods_and_rounds(spark, round_blocks):
    """Many near words, chains of forms, ties, letters beyond ASCII; also with
    filters cut into several rounds."""
    rng = random.Random(3)
    docs = []
    for i in range(900):
        w = "".join(rng.choice("abéÿZ"[:rng.randrange(2, 6)]) for _ in range(rng.randrange(5, 8)))
        docs.append((i, " ".join([w] * rng.randrange(3, 30))))
    docs += [(1000 + i, " ".join(["x" * (40 + i % 5)] * (3 << i % 5))) for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute(docs, slips=False)
    assert max(r[4] for r in want) > 5 and any(r[2] not in (r[0], r[1]) for r in want)
    assert grouped(df, round_blocks=round_blocks) == want


def test_tasks_send_full_tables_on(spark):
    docs = [(i, f"alpha{chr(97 + i % 7)} betaa alphab gamma") for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.word: r.n for r in spelling.count_words(df, slips=True, hold=3).where("n >= 3").collect()}
    assert got == brute_words(docs, True)


def test_edge_rows(spark):
    rows = EDGE + [(30, "Straße STRASSE strasse straße straße", "de"), (31, "colour colour colour color color color color color color", "en"),
                   (31, "colour", "en"), (None, "colour color", "en"), (32, "ABCDÉ ABCDÉ ABCDÉ abcdé", None)]
    assert grouped(edge_docs(spark, rows), slips=True) == brute([(d, t) for d, t, _ in rows])
    got = {r[0]: r for r in grouped(edge_docs(spark, rows))}
    assert got["colour"][:3] == ("colour", None, "colour") and got["colour"][4] == 1
    assert "abcdÉ" in got and "abcdé" not in got                  # only A-Z are lowered
    assert LONG and grouped(empty_docs(spark)) == []
    assert grouped(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")) == []
