import hashlib

import public_tokenizers as pt
import pytest
from helpers_llm import EDGE, LONG, edge_docs, empty_docs
from riskframe.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    with open(pt.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def test_round_trip_matches_the_library(spark, ranks):
    enc = bpe.encoding(ranks, pt.PATTERN)
    got = bpe.bpe_round_trip(edge_docs(spark), ranks, pt.PATTERN, limit=64).collect()
    want = []
    for i, t, _ in EDGE:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_encode_then_decode(spark, ranks):
    ids = bpe.bpe_encode(edge_docs(spark), ranks, pt.PATTERN)
    back = bpe.bpe_decode(ids, ranks, pt.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.bytes).decode()) for r in back) == sorted((str(i), t or "") for i, t, _ in EDGE)


def test_decoding_a_cut_gives_raw_bytes(spark, ranks):
    enc = bpe.encoding(ranks, pt.PATTERN)
    ids = enc.encode_ordinary("𝄞𝄞")[:-1]
    got = bpe.bpe_decode(spark.createDataFrame([(1, ids), (2, None)], "doc_id long, ids array<int>"), ranks, pt.PATTERN).collect()
    assert {r.doc_id: bytes(r.bytes) for r in got} == {1: enc.decode_bytes(ids), 2: b""}


@pytest.mark.parametrize("text", [LONG, "a  b   c \n d" * 400, " lead" * 99, "x" * 4000, "", "é é   é" * 50])
def test_pieces_encode_to_the_whole(ranks, text):
    enc = bpe.encoding(ranks, pt.PATTERN)
    for limit in (1, 7, 100):
        pieces = list(bpe.safe_pieces(text, limit))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_empty_table(spark, ranks):
    assert bpe.bpe_round_trip(empty_docs(spark), ranks, pt.PATTERN).count() == 0
