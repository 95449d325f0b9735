"""Periodic run detection with multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q and a length of
at least ``max(6, 4 q)`` that no neighbouring word extends. All runs are found:

* Periods below ``DIRECT`` by direct scans: words equal to the word one lag
  later, in stretches that are long enough.
* For every scale w (a power of two from ``DIRECT`` on) the periods from w up
  to 2 w - 1 by minimizers. Hashes of 2 w words are built by doubling; a
  position is selected if its hash is the least of some window of w positions.
  Inside a run windows one period apart are alike, so a selected position and
  the one a period later have equal hashes; nothing in between has, because
  2 w words hold at least a period. So consecutive equal minimizers at a
  distance of w to 2 w - 1 are seeds, and each is extended word by word. A run
  of 4 q words or more has a seed; about 2 n / w positions are selected.

A stretch found with several lags keeps the smallest, its period. Texts are
taken together, each ended by a word of its own that no run can cross. Hashes
are 64 bits wide; every run reported is checked word by word."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, rows, text_or_empty

LEAST, TIMES = 6, 4
#: Periods below are found by direct scans; a power of two.
DIRECT = 16
#: Bytes of text that are scanned together (one longer text is taken alone).
CHUNK_BYTES = 2 << 20


def long_enough(period: int) -> int:
    return max(LEAST, TIMES * period)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repetition that the query's contract plants; a NULL
    doc_id plants none."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """``best`` of every w (a power of two) consecutive entries."""
    span = 1
    while span < w:
        x = best(x[:-span], x[span:])
        span *= 2
    return x


def _seeds(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of consecutive equal minimizers at a distance of
    w to 2 w - 1. ``h``: hashes of 2 w words from every position on."""
    low = _sliding(h, w, np.minimum)                       # least hash of every window
    # a position is selected if the greatest of its windows' least hashes is its own
    top = np.zeros(len(h) + w - 1, dtype=np.uint64)
    top[w - 1:w - 1 + len(low)] = low
    at = np.flatnonzero(_sliding(top, w, np.maximum) == h)
    order = at[np.argsort(h[at], kind="stable")]
    gap = np.diff(order)
    hit = (h[order[1:]] == h[order[:-1]]) & (gap >= w) & (gap < 2 * w)
    return order[:-1][hit], gap[hit]


def _reach(x: np.ndarray, i: int, lag: int, step: int, stop: int) -> int:
    """First place from ``i`` on, in steps of +1 or -1 up to ``stop``, where a
    word differs from the one ``lag`` later; ``stop`` if there is none."""
    size = 64
    while (stop - i) * step > 0:
        size = min(size, abs(stop - i))
        a, b = (i, i + size) if step > 0 else (i - size + 1, i + 1)
        differ = np.flatnonzero(x[a:b] != x[a + lag:b + lag])
        if len(differ):
            return a + int(differ[0 if step > 0 else -1])
        i += step * size
        size *= 2
    return stop


def find_runs(x: np.ndarray, longest: int) -> np.ndarray:
    """All runs of the word numbers ``x`` as rows (start, length, period), by
    start, then period. No run is longer than ``longest`` words."""
    n = len(x)
    found: list[np.ndarray] = []
    for q in range(1, min(DIRECT, longest // TIMES + 1)):
        need = long_enough(q)
        if need > n:
            break
        same = np.zeros(n - q + 2, dtype=np.int8)
        same[1:-1] = x[q:] == x[:-q]
        edge = np.flatnonzero(np.diff(same))
        start, length = edge[::2], edge[1::2] - edge[::2] + q
        ok = length >= need
        found.append(np.stack([start[ok], length[ok], np.full(int(ok.sum()), q)], axis=1))
    h, span, w = _mixed(x.astype(np.uint64) + np.uint64(1)), 1, DIRECT
    while TIMES * w <= longest:
        while span < 2 * w:                                  # hashes of twice as many words
            h = _mixed(h[:-span] * np.uint64(3) + _mixed(h[span:]))
            span *= 2
        if len(h) < w:
            break
        start, lag = _seeds(h, w)
        by_lag = np.lexsort((start, lag))
        last, end = -1, -1
        for p, q in zip(start[by_lag].tolist(), lag[by_lag].tolist()):
            if q == last and p < end:
                continue                                     # inside the stretch extended before
            right = _reach(x, p, q, 1, n - q)
            left = _reach(x, p - 1, q, -1, -1) + 1
            last, end = q, right
            if right - left + q >= long_enough(q):
                found.append(np.array([[left, right - left + q, q]]))
        w *= 2
    if not found:
        return np.zeros((0, 3), dtype=np.int64)
    runs = np.concatenate(found).astype(np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), dtype=bool)                   # of one stretch only the smallest period
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def chunks(records: Iterator[tuple], weight) -> Iterator[list[tuple]]:
    held, size = [], 0
    for r in records:
        if held and size + weight(r) > CHUNK_BYTES:
            yield held
            held, size = [], 0
        held.append(r)
        size += weight(r)
    if held:
        yield held


def runs_of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Per text (a list of words) its runs as rows (start, length, period)."""
    number: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    x = np.empty(first[-1], dtype=np.int32)
    for i, t in enumerate(texts):
        x[first[i]:first[i] + len(t)] = [number.setdefault(w, len(number)) for w in t]
    x[first[1:] - 1] = np.arange(len(number), len(number) + len(texts))       # a word of its own ends every text
    runs = find_runs(x, int(sizes.max(initial=0)))
    owner = np.searchsorted(first, runs[:, 0], side="right") - 1
    runs[:, 0] -= first[owner]
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [runs[a:b] for a, b in zip(cut, cut[1:])]


def greatest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, exactly; ties go to the smallest
    start, then period."""
    if not len(runs):
        return None
    rough = runs[:, 1] / runs[:, 2]
    near = runs[rough >= rough.max() * (1 - 1e-9)].tolist()
    return tuple(min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])))


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those after the first period of a run."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


_FOUND = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64()))), ("n_words", pa.int64()),
                    ("text", pa.large_string())])
_FOUND_DDL = "doc_id long, runs array<array<long>>, n_words long, text string"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                     ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()),
                     ("collapsed_sha256", pa.string())])
_DIGEST_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, " \
    "runs_sha256 string, collapsed_sha256 string"


def _per_document(docs: DataFrame, make, plant: bool, schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches):
        def out():
            for part in chunks(rows(batches), lambda r: len(r[1])):
                words = [t.encode().split() for _, t in part]
                if plant:
                    words = [planted(w, doc) for (doc, _), w in zip(part, words)]
                for (doc, _), w, runs in zip(part, words, runs_of_texts(words)):
                    yield make(doc, w, runs)
        return batches_of(out(), schema, weigh=lambda r: sum(len(v) for v in r if isinstance(v, (str, list))))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, ddl)


def periodic_runs(docs: DataFrame, *, plant: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``runs`` (start, length and period of
    each, in words, by start, then period), ``n_words``, ``text`` (the words
    left when of every run only the first period stays, joined by one space).
    ``plant`` puts the contract's repetition into every tenth document first.

    Words are runs without white space (space, tab to CR). NULL and empty text
    has no word. A NULL doc_id stays NULL and gets no planted repetition;
    repeated rows each give a row; an empty table gives none. Other columns are
    not read. A text of any length is one unit of work; it holds about 100
    bytes a word while it is scanned."""
    return _per_document(docs, lambda doc, w, runs: (doc, runs.tolist(), len(w), b" ".join(collapsed(w, runs)).decode()),
                         plant, _FOUND, _FOUND_DDL)


def run_digests(docs: DataFrame, *, plant: bool = True) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_runs``, the run of the greatest
    length / period (``start``, ``length``, ``period``, ``exponent_milli``; NULL
    without runs), ``runs_sha256`` (digest of ``start,length,period`` lines) and
    ``collapsed_sha256`` (digest of the text of :func:`periodic_runs`). Edge
    cases as there."""
    def digest(doc, w, runs):
        best = greatest(runs) or (None, None, None)
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs.tolist())
        return (doc, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(),
                hashlib.sha256(b" ".join(collapsed(w, runs))).hexdigest())

    return _per_document(docs, digest, plant, _DIGEST, _DIGEST_DDL)
