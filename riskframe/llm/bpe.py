"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, rows, text_or_empty

#: Texts longer than this are cut at safe boundaries before they are encoded.
LONG_CHARS = 1 << 16

# A cut in front of one space that stands between two characters that aren't
# white space never lies inside a match of the split pattern, whose matches
# hold a space only in front or within white space.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def rank_lines(spark: SparkSession, path: str) -> bytes:
    """The rank file's bytes (a vocabulary file, about 1 MB), read on the driver."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str, special: tuple = ()):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens=dict(special))


def safe_pieces(text: str, limit: int = LONG_CHARS) -> Iterator[str]:
    """``text`` in pieces of about ``limit`` characters that encode one by one
    to the same ids as the whole text. A stretch without a safe boundary stays
    whole."""
    start = 0
    while len(text) - start > limit:
        m = _SAFE.search(text, start + limit)
        if m is None:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:] if start else text


def encode(enc, text: str, limit: int = LONG_CHARS) -> list[int]:
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text, limit):
        ids += enc.encode_ordinary(piece)
    return ids


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                     ("decoded_sha256", pa.string())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_TEXT = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])


def bpe_encode(docs: DataFrame, ranks: bytes, pattern: str, *, limit: int = LONG_CHARS) -> DataFrame:
    """``doc_id``, ``ids`` array<int> of every row's whole text (NULL: empty,
    no ids). Repeated rows each give a row; an empty table gives none."""
    def run(batches):
        enc = encoding(ranks, pattern)
        return batches_of(((i, encode(enc, t, limit)) for i, t in rows(batches)), _IDS, size=512,
                          weigh=lambda r: 8 * len(r[1]))
    return _input(docs).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(ids: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``doc_id``, ``bytes``: the raw bytes behind the ids (which need not be
    valid UTF-8 when the ids were cut)."""
    def run(batches):
        enc = encoding(ranks, pattern)
        return batches_of(((i, enc.decode_bytes(x or [])) for i, x in rows(batches)), _TEXT, size=512,
                          weigh=lambda r: len(r[1]))
    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")) \
        .mapInArrow(run, "doc_id long, bytes binary")


def bpe_round_trip(docs: DataFrame, ranks: bytes, pattern: str, *, limit: int = LONG_CHARS) -> DataFrame:
    """Encode and decode in one pass: ``doc_id``, ``n_tokens``, ``ids_sha256``
    (decimal ids joined by commas), ``decoded_sha256`` (raw decoded bytes).
    One row per input row; NULL text is the empty text (no tokens, digests of
    the empty string). No shuffle."""
    def run(batches):
        enc = encoding(ranks, pattern)
        decimal = [str(i) for i in range(enc.n_vocab)]

        def one(i, text):
            ids = encode(enc, text, limit)
            return (i, len(ids), hashlib.sha256(",".join([decimal[x] for x in ids]).encode()).hexdigest(),
                    hashlib.sha256(enc.decode_bytes(ids)).hexdigest())

        return batches_of((one(i, t) for i, t in rows(batches)), _DIGEST)
    return _input(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
