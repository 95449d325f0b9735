import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers_llm import EDGE, edge_docs, empty_docs
from riskframe.llm import lm


def words(text):
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", low) + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def corpus(n=400, seed=2):
    """Two languages: within one the next word depends on the last."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        side = rng.choice("xy")
        w, out = rng.randrange(40), []
        for _ in range(rng.randint(20, 80)):
            w = (w * 3 + rng.choice((1, 1, 1, 5))) % 40
            out.append(f"{side}{w}" if rng.random() < 0.97 else f"rare{rng.randrange(5000)}")
        rows.append((i, " ".join(out), "en"))
    return rows


def check_base(got, rows):
    counts = Counter(w for i, t, _ in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, _ in rows:
        ws = words(t)
        want.append((str(i), held(i), len(ws), sum(counts[w] > 0 for w in ws), n,
                     round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)))
    assert sorted(want) == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)


def test_base_is_exact_and_model_beats_it_on_held_out(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for hot in (lm.HOT, 30):                  # with and without words that come by the join
        got = lm.score_texts(df, hot=hot).collect()
        check_base(got, rows)
        out = [r for r in got if r.held_out]
        if hot == lm.HOT:
            assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.1 * sum(r.n_tokens for r in out)


def test_edge_rows(spark):
    got = lm.score_texts(edge_docs(spark)).collect()
    check_base(got, EDGE)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_empty_table_and_nothing_to_learn_from(spark):
    assert lm.score_texts(empty_docs(spark)).count() == 0
    only = [i for i in range(100) if held(i)][:3]
    got = lm.score_texts(spark.createDataFrame([(i, "a b") for i in only], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)] * 3
    assert all(abs(r.base_score) < 1e-9 and abs(r.score) < 1e-6 for r in got)


def test_model_is_a_distribution(spark):
    rows = corpus(120)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, types, least, n, v = lm.fit(df.select("text"), hot=50)
    f = np.random.default_rng(0).integers(0, lm.ROWS, (20, 3)).astype(np.int32)
    p = lm.class_probabilities(model.weights, model.bias, f)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    inside = np.zeros((lm.CLASSES, lm.PARTS))
    np.add.at(inside, (model.hot_class, model.hot_part), model.hot_count + 1.0)
    rare = types.where(types.n < least).collect()
    inside[-1, 0] = sum(r.n + 1 for r in rare) + 1
    assert np.allclose(inside, model.mass)                       # P(word | part) sums to one
    assert p[:, model.mass.sum(axis=1) == 0].sum() < 1e-6
    some = np.flatnonzero(model.mass.sum(axis=1) > 0)
    rows = np.random.default_rng(1).integers(0, lm.PART_ROWS, len(some)).astype(np.int32)
    q = lm.part_probabilities(model.part_weights, model.part_bias, rows, some)
    assert np.allclose(q.sum(axis=1), 1, atol=1e-5) and q[model.mass[some] == 0].sum() < 1e-6


def test_context_separates_words_of_one_class(spark):
    """On held-out text the context tells the part of a class better than its
    share does, so words of one class are told apart."""
    rows = corpus(600, seed=8)
    df = spark.createDataFrame([r for r in rows if not held(r[0])], "doc_id long, text string, lang string")
    model, *_ = lm.fit(df.select("text"), hot=120)
    t = lm.tokens_of(pa.array([r[1] for r in rows if held(r[0])]))
    y, part = model.classes(t.keys)[t.ids], model.parts(t.keys)[t.ids]
    inner = np.flatnonzero((y < lm.CLASSES - 1) & ((model.mass[y] > 0).sum(axis=1) > 1))
    q = lm.part_probabilities(model.part_weights, model.part_bias, lm.part_rows(lm.previous(t), y)[inner], y[inner])
    share = np.exp(model.part_bias[y[inner], part[inner]])
    gain = np.log10(q[np.arange(len(inner)), part[inner]]) - np.log10(share)
    assert len(inner) > 500 and gain.mean() > 0.05


def test_tokens_and_features():
    t = lm.tokens_of(pa.array(["A b\x0ba", "", "  c  É ", "b"]))
    texts = [t.keys[t.ids[a:b]].tolist() for a, b in zip(t.starts, t.starts[1:])]
    key = lambda w: lm.xxhash.xxh64_intdigest(w)
    end = int(lm.END)
    assert texts == [[key(b"a"), key(b"b"), key(b"a"), end], [end], [key(b"c"), key("É".encode()), end], [key(b"b"), end]]
    f = lm.features(t)
    assert (f[0] == f[4]).all() and (f[0] == f[5]).all()
    assert f[1, 0] != f[0, 0] and f[1, 2] == f[0, 2]             # after the first word: new bigram, same skip
    assert f.max() < lm.ROWS and f.min() >= 0


def test_updates_are_no_larger_than_the_text():
    assert lm.workers(0) == 1
    for tokens in (10**6, 10**8, 10**12):
        assert lm.workers(tokens) * lm.MODEL_BYTES <= max(tokens * lm.TOKEN_BYTES, lm.MODEL_BYTES)
    x = np.random.default_rng(1).random((3, lm.CLASSES + 1)).astype(np.float32)
    sent = [lm._update(4, 0, np.array(at), x[:len(at)]) for at in ([5, 900, 1023], [900, 901])]
    (got,) = lm._sum_blocks(iter(sent))
    at, v = lm._rows_of(got.column(2)[0].as_py(), got.column(3)[0].as_py())
    assert at.tolist() == [5, 900, 901, 1023]                    # rows that nobody touched are not sent
    assert np.allclose(v, [x[0], x[1] + x[0], x[1], x[2]])


def test_softmax_of_rows_far_apart():
    z = np.array([[0, 1, 2], [-500, -501, -502], [300, 300, -30], [-90, -30, -90]], dtype=np.float32)
    e = np.exp(z.astype(float) - z.max(axis=1, keepdims=True))
    assert np.allclose(lm.softmax(z.copy()), e / e.sum(axis=1, keepdims=True), atol=1e-6)
    assert lm.softmax(np.zeros((0, 3), dtype=np.float32)).shape == (0, 3)
