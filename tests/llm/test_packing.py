import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers as pt
import pytest
import tokenizers
from helpers_llm import EDGE, edge_docs, empty_docs
from riskframe.llm import packing
from riskframe.llm.bpe import encoding
from riskframe.llm.queries import SPECIAL_50K


@pytest.fixture(scope="module")
def ranks():
    with open(pt.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(pt.path("byte_bpe_50k.json"))


def check(pieces, want, window):
    """Every id of every row in exactly one piece; sequences gapless."""
    seq, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert 0 < p.length <= window
        seq[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id, p.doc_tokens].append((p.start, p.length, p.ids_crc32))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    got = sorted(str((k[0], sorted(v))) for k, v in docs.items())
    expect = defaultdict(list)
    for i, ids in want:
        for s in range(0, len(ids), window):
            x = ids[s:s + window]
            expect[i, len(ids)].append((s, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))))
    assert got == sorted(str((k[0], sorted(v))) for k, v in expect.items())
    return len(seq)


def test_edge_rows(spark, ranks, library):
    want = [(i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, _ in EDGE]
    got = packing.pack_documents(edge_docs(spark), ranks, pt.PATTERN, SPECIAL_50K, windows=2, fan_in=2).collect()
    check(got, want, 1024)


def test_little_padding_and_best_fit(spark, ranks, library):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(("cat", "dog", "house")) for _ in range(rng.randint(0, 40))), "") for i in range(600)]
    want = [(i, library.encode(t, add_special_tokens=False).ids + [0]) for i, t, _ in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = packing.pack_documents(df, ranks, pt.PATTERN, SPECIAL_50K, window=64, windows=16).collect()
    n = check(got, want, 64)
    assert n * 64 <= 1.05 * sum(len(ids) for _, ids in want) + 64


def test_open_windows_are_bounded_and_best_fit():
    w = packing.OpenWindows(10, 2)
    assert list(w.place(6, "a")) == [] and list(w.place(7, "b")) == []
    assert list(w.place(3, "c")) == [["b", "c"]]             # the fuller one that fits
    assert list(w.place(9, "d")) == []
    assert list(w.place(8, "e")) == [["d"]]                  # none fits: the fullest goes
    assert w.rest() == [["e"], ["a"]] and len(w.free) == 2


@pytest.mark.parametrize("text", ["", " ", "a", " a b", "a  b", "a \n b\n\nc", " x y  z", "it's <|endoftext|> <|endoftext|>x",
                                  "tab\t x", "x\x1c y", "ends ", "né 12 ½x ..!"])
def test_ids_equal_the_tokenizers_library(ranks, library, text):
    ids = packing.ChunkIds(encoding(ranks, pt.PATTERN, tuple(SPECIAL_50K.items())), SPECIAL_50K)
    for _ in range(2):
        got = ids.text_ids(text)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == library.encode(text, add_special_tokens=False).ids


def test_empty_table(spark, ranks):
    assert packing.pack_documents(empty_docs(spark), ranks, pt.PATTERN, SPECIAL_50K).count() == 0
