import random
import zlib

from helpers_llm import edge_docs, empty_docs
from riskframe.llm import toxicity

BAD = ["vile", "rotten", "foulish", "grimy"]


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", ".", ","]))
        docs.append((i, " ".join(words), "en"))
        if rng.random() < 0.7:
            labels.append((i, 1, int(bad)))
    return docs, labels, {i for i, t, _ in docs if any(b in t for b in BAD)}


def frames(spark):
    docs, labels, toxic = corpus()
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxic)


def test_held_out_accuracy_and_columns(spark):
    docs, labels, toxic = frames(spark)
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 1500
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id in toxic) for r in held) >= 0.97 * len(held)


def test_edge_rows_and_empty_tables(spark):
    docs, labels, _ = frames(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(edge_docs(spark), model).collect()
    assert len(got) == 13 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.score(empty_docs(spark), model).count() == 0
    assert toxicity.clean_documents(edge_docs(spark), model).columns == edge_docs(spark).columns
    no_labels = labels.limit(0)
    for d in (docs, empty_docs(spark)):
        blank = toxicity.fit(d, no_labels)
        assert all(0 < r.score < 1 for r in toxicity.score(d, blank).collect())
    dirty = labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, 1, None), (77777, 0, 1)], labels.schema))
    toxicity.fit(docs, dirty)


def test_clean_documents_filters_rows(spark):
    docs, labels, toxic = frames(spark)
    model = toxicity.fit(docs, labels)
    kept = {r.doc_id for r in toxicity.clean_documents(docs, model).collect()}
    rejected = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert kept == set(range(1500)) - rejected and len(rejected & toxic) >= 0.95 * len(toxic)


def brute_segments(scores):
    """All maximal scoring subsequences by the recursive definition."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                best = (a, b, total)
    if best is None:
        return []
    a, b, t = best
    return brute_segments(scores[:a]) + [best] + [(x + b + 1, y + b + 1, s) for x, y, s in brute_segments(scores[b + 1:])]


def test_segments_match_the_definition():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(0, 25)
        scored = [(i, rng.choice([3.1, 1.7, -2.3, -0.9])) for i in range(n) if rng.random() < 0.5]
        full = [-0.25] * n
        for i, s in scored:
            full[i] = s
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(scored, 0.25)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute_segments(full)]


def test_passages_are_the_planted_ones(spark):
    docs, labels, _ = frames(spark)
    model = toxicity.fit(docs, labels)
    text = " ".join(["waa"] * 60 + BAD + ["wba"] * 60)
    found = [(r.first_token, r.last_token) for r in toxicity.passages(
        spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()]
    assert found == [(60, 63)]


def test_segments_follow_links():
    """Falling sums: every hit would step over all earlier segments."""
    import random
    import time

    def plain(scored, drift):
        found, total, last = [], 0.0, -1
        for at, s in scored:
            total -= drift * (at - last - 1)
            last = at
            if s <= 0:
                total += s
                continue
            start, before, total = at, total, total + s
            while True:
                j = max((i for i, f in enumerate(found) if f[2] < before), default=-1)
                if j < 0 or found[j][3] >= total:
                    found.append([start, at, before, total])
                    break
                start, before = found[j][0], found[j][2]
                del found[j:]
        return [(a, b, up - low) for a, b, low, up in found]

    rng = random.Random(8)
    for _ in range(200):
        scored = [(i, rng.choice((-2.0, -1.0, 0.5, 1.0, 1.5))) for i in range(60) if rng.random() < 0.7]
        assert toxicity.segments(scored, 0.3) == plain(scored, 0.3)
    began = time.process_time()
    assert len(toxicity.segments([(20 * i, 0.5) for i in range(60_000)], 0.05)) == 60_000
    assert time.process_time() - began < 5
