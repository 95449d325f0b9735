"""Bounded-space online packing of token sequences.

Every input partition reads its documents once and keeps at most ``windows``
open windows. A document's full windows go out at once; its rest goes to the
open window that it fills best. When none fits and all windows are open, the
fullest is emitted. The windows still open at the end of a partition are
merged with those of its neighbours, ``fan_in`` partitions at a time, by best
fit over the pieces in decreasing length. No task holds more than its open
windows' piece descriptions; tokens never leave the task that made them.
"""

from __future__ import annotations

import bisect
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoding
from .common import batches_of, rows, stored, text_or_empty

WINDOW = 1024
#: Open windows per partition.
WINDOWS = 256
#: Partitions whose leftover windows are merged together.
FAN_IN = 16
#: Word chunks whose ids a worker remembers.
CACHE = 300_000

_SAFE = re.compile(r"(?<=\S) (?=\S)")


class _Unsafe(Exception):
    pass


class ChunkIds(dict):
    """ids (packed little-endian uint32) of " " + chunk, for chunks that stand
    between safe boundaries; bounded."""

    def __init__(self, enc, special: dict[str, int]):
        super().__init__()
        self.enc, self.special = enc, special

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.enc.encode(text, allowed_special="all")
        else:
            ids = self.enc.encode_ordinary(text)
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Unsafe
        if len(self) >= CACHE:
            self.clear()
        out = self[chunk] = self.encode(" " + chunk)
        return out

    def text_ids(self, text: str) -> bytes:
        """Packed ids of a whole text. A boundary in front of one space between
        two characters that aren't white space never lies inside a match of the
        split pattern, so the chunks encode one by one to the whole text's ids."""
        first, *rest = text.split(" ")
        if not first[-1:].isspace():
            try:
                return (self.encode(first) if first else b"") + b"".join(map(self.__getitem__, rest))
            except _Unsafe:
                pass
        first, *rest = _SAFE.split(text)
        out = [self.encode(first)]
        for chunk in rest:
            out.append(self[chunk] if not chunk[0].isspace() and not chunk[-1].isspace()
                       else self.encode(" " + chunk))
        return b"".join(out)


class OpenWindows:
    """At most ``limit`` open windows, ordered by free space (ties: older first)."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.made = size, limit, 0
        self.free: list[tuple[int, int]] = []          # sorted (free tokens, window)
        self.pieces: dict[int, list[tuple]] = {}

    def place(self, length: int, piece: tuple) -> Iterator[list[tuple]]:
        """Put a piece in the window it fills best; yields windows that close."""
        at = bisect.bisect_left(self.free, (length, -1))
        if at == len(self.free):
            if len(self.free) >= self.limit:
                yield self.pieces.pop(self.free.pop(0)[1])    # the fullest
            space, window = self.size, self.made
            self.made += 1
            self.pieces[window] = []
        else:
            space, window = self.free.pop(at)
        self.pieces[window].append(piece)
        if space == length:
            yield self.pieces.pop(window)
        else:
            bisect.insort(self.free, (space - length, window))

    def rest(self) -> list[list[tuple]]:
        return [self.pieces[w] for _, w in self.free]


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                     ("offset", pa.int64()), ("part", pa.int64())])
_DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, part long")


def _numbered(window: list[tuple], sequence: int, part) -> Iterator[tuple]:
    at = 0
    for piece in window:
        yield (*piece, sequence, at, part)
        at += piece[2]


def pack_documents(docs: DataFrame, ranks: bytes, pattern: str, special: dict[str, int], *, end_id: int = 0,
                   window: int = WINDOW, windows: int = WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """Per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``. Every document ends with ``end_id``, so a NULL or empty text is
    one token. Pieces of one sequence are gapless from offset 0 and hold at
    most ``window`` tokens; each token of each row lies in exactly one piece.
    Rows repeated with one doc_id are packed as documents of their own; an
    empty table gives no piece. Ids: tiktoken over the tokenizer's vocabulary
    with its special tokens recognised, as the tokenizers library does."""
    end = array("I", [end_id]).tobytes()

    def run(batches):
        part = TaskContext.get().partitionId()
        base = part << 32
        count = 0
        ids_of = ChunkIds(encoding(ranks, pattern, tuple(special.items())), special)
        open_windows = OpenWindows(window, windows)

        def out():
            nonlocal count
            for doc, text in rows(batches):
                ids = ids_of.text_ids(text) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece_ids = ids[4 * start:4 * (start + window)]
                    length = len(piece_ids) // 4
                    piece = (doc, start, length, zlib.crc32(piece_ids), total)
                    for closed in [[piece]] if length == window else open_windows.place(length, piece):
                        yield from _numbered(closed, base + count, None)
                        count += 1
            for left in open_windows.rest():
                yield from _numbered(left, base + count, part)
                count += 1

        return batches_of(out(), _PIECES)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # stored: the encoding runs once for both halves, and sequence numbers stay fixed
    pieces = stored(src.mapInArrow(run, _DDL), "packing")
    done = pieces.where("part IS NULL").drop("part")
    left = pieces.where("part IS NOT NULL") \
        .withColumn("part", F.floor(F.col("part") / F.lit(fan_in)).cast("long")) \
        .groupBy("part").applyInArrow(_merge_leftovers(window), _DDL).drop("part")
    return done.unionByName(left)


def _merge_leftovers(window: int):
    def run(table: pa.Table) -> pa.Table:
        pieces = sorted(zip(*(table.column(c).to_pylist() for c in _PIECES.names)),
                        key=lambda r: (-r[2], r[5], r[6]))
        group = table.column("part")[0].as_py()
        base, out, count = (1 << 61) | (group << 32), [], 0
        merged = OpenWindows(window, len(pieces) + 1)     # bounded: fan_in x windows leftovers
        closed = [w for r in pieces for w in merged.place(r[2], r[:5])] + merged.rest()
        for count, win in enumerate(closed):
            out += _numbered(win, base + count, group)
        return pa.Table.from_batches(list(batches_of(iter(out), _PIECES)), schema=_PIECES)
    return run
