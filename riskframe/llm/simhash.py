"""SimHash near-dedup with a pigeonring filter.

A fingerprint has 64 bits. Its ``SEGMENTS`` segments stand on a ring. If two
fingerprints differ in at most ``bits`` bits, there is a segment from which
every chain of l consecutive segments differs in at most l * bits / SEGMENTS
bits in all (the pigeonring principle). So

* the chain of the first ``(SEGMENTS - 1) // bits`` segments is equal: it is
  the key that candidates share;
* the longer chains' budgets prune candidates before the full Hamming check.

Only distinct fingerprints are compared. A key's fingerprints are compared
with each other inside the task that holds their sorted run; a long run is
dealt out again by the same principle over the bits that the key leaves free,
so no run is compared all with all. Links leave a task as a spanning forest,
never as all pairs. Components are found by alternating large- and small-star
rounds over the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, rows, stored, text_or_empty

SHINGLE = 3
BITS = 2
SEGMENTS = 8
SEED = 42
#: Runs up to this long are compared directly; longer ones are dealt out again.
DIRECT = 128
_BLOCK = 1 << 15

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits over XXH64 of the word shingles, repeats included; a bit is 1 if
    it is set in over half of them. 0 without words."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(join(words), SEED)
    n = len(words) - shingle + 1
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, n, _BLOCK):
        part = words[start:start + _BLOCK + shingle - 1]
        h = np.array([digest(join(s), SEED) for s in zip(*(part[k:] for k in range(shingle)))], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


_PRINTS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``text_key`` (hash of the text), ``fp`` (the 64 bits as a
    signed long) per row, over whole texts."""
    def run(batches):
        def signed(x):
            return x - (1 << 64) if x >> 63 else x
        return batches_of(((i, k, signed(fingerprint(t, shingle))) for i, k, t in rows(batches)), _PRINTS)

    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       text.alias("text")).mapInArrow(run, "doc_id long, text_key long, fp long")


# -- candidates ------------------------------------------------------------------------

def _groups(free: int, segments: int) -> list[tuple[int, int]]:
    """``free`` bits cut into ``segments`` segments: (first bit, end)."""
    cut = [free * i // segments for i in range(segments + 1)]
    return list(zip(cut, cut[1:]))


def ring_masks(free: list[int], segments: int, bits: int) -> list[list[int]]:
    """For each start on the ring, the masks of its chains of 1, 2, ... segments
    over the bit positions ``free``."""
    masks = [sum(1 << free[b] for b in range(a, e)) for a, e in _groups(len(free), segments)]
    out = []
    for start in range(segments):
        chain, chains = 0, []
        for step in range(segments):
            chain |= masks[(start + step) % segments]
            chains.append(chain)
        out.append(chains)
    return out


def _pairs_of_run(key: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within runs of equal sorted keys, by distance."""
    for shift in range(1, longest):
        hit = np.flatnonzero(key[shift:] == key[:-shift])
        if not len(hit):
            return
        yield hit, hit + shift


def _within(x: np.ndarray, chains: list[int], bits: int) -> np.ndarray:
    """Which differences ``x`` keep every chain's budget and the full one."""
    ok = np.ones(len(x), dtype=bool)
    m = len(chains)
    for length in range((m - 1) // bits + 1, m + 1):
        some = np.flatnonzero(ok)
        ok[some] = np.bitwise_count(x[some] & np.uint64(chains[length - 1])) <= length * bits // m
    some = np.flatnonzero(ok)
    ok[some] = np.bitwise_count(x[some]) <= bits
    return ok


def links_in(prints: np.ndarray, key: np.ndarray, chains: list[int] | None, free: list[int],
             bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs at ``bits`` or fewer differing bits inside runs of equal ``key``
    (sorted); ``free``: bit positions the key leaves open."""
    if len(key) < 2:
        return
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    sizes = np.diff(edges)
    small = np.repeat(sizes <= DIRECT, sizes)
    fp, k = prints[small], key[small]
    for i, j in _pairs_of_run(k, DIRECT):
        x = fp[i] ^ fp[j]
        ok = _within(x, chains, bits) if chains else np.bitwise_count(x) <= bits
        yield fp[i[ok]], fp[j[ok]]
    for r in np.flatnonzero(sizes > DIRECT):
        run = prints[edges[r]:edges[r + 1]]
        segments = next(m for m in (5, 6, 8, 16, 32, 64) if (m - 1) // bits and len(free) * ((m - 1) // bits) // m >= 4 or m == 64)
        if len(free) <= 9:                      # at most 512 fingerprints are left
            for s in range(1, len(run)):
                ok = np.bitwise_count(run[s:] ^ run[:-s]) <= bits
                yield run[s:][ok], run[:-s][ok]
            continue
        segments = min(segments, len(free))
        width = max((segments - 1) // bits, 1)
        for chains_of in ring_masks(free, segments, bits):
            mask = chains_of[width - 1]
            sub = run & np.uint64(mask)
            order = np.lexsort((run, sub))
            yield from links_in(run[order], sub[order], None, [b for b in free if not mask >> b & 1], bits)


def spanning(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs (union-find over those met so far)."""
    parent: dict[int, int] = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for left, right in pairs:
        for a, b in zip(left.tolist(), right.tolist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                yield a, b


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Sorted rows held at once; a longer run is held as a whole (8 bytes a fingerprint).
_HOLD = 1 << 17


def links(prints: DataFrame, *, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) at ``bits`` or
    fewer differing bits: enough of them to join all that are linked."""
    rings = ring_masks(list(range(64)), segments, bits)
    width = (segments - 1) // bits if bits else segments
    if width < 1:
        raise ValueError("needs more segments than bits")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.struct(F.lit(s).alias("ring"), F.col("fp").bitwiseAND(F.lit(signed(c[width - 1])).cast("long")).alias("key"))
                     for s, c in enumerate(rings)])
    dealt = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.ring", "k.key") \
        .repartition("ring", "key").sortWithinPartitions("ring", "key", "fp").select("ring", "key", "fp")

    def run(batches):
        def found():
            held = []
            for ring, key, fp in _arrays(batches):
                held.append((ring, key, fp))
                if sum(len(h[0]) for h in held) < _HOLD:
                    continue
                ring, key, fp = (np.concatenate(c) for c in zip(*held))
                cut = np.flatnonzero((ring[1:] != ring[:-1]) | (key[1:] != key[:-1]))
                end = cut[-1] + 1 if len(cut) else 0          # the last run may go on
                yield from compare(ring[:end], key[:end], fp[:end])
                held = [(ring[end:], key[end:], fp[end:])]
            if held:
                yield from compare(*(np.concatenate(c) for c in zip(*held)))

        def compare(ring, key, fp):
            for s in range(segments):
                at = ring == s
                mask = rings[s][width - 1]
                yield from links_in(fp[at].view(np.uint64), key[at].view(np.uint64), rings[s],
                                    [b for b in range(64) if not mask >> b & 1], bits)

        to_signed = lambda pairs: ((a.view(np.int64), b.view(np.int64)) for a, b in pairs)
        return batches_of(spanning(to_signed(found())), _LINKS)

    return dealt.mapInArrow(run, "a long, b long")


def _arrays(batches):
    for b in batches:
        if b.num_rows:
            yield tuple(np.array(b.column(i).to_numpy(zero_copy_only=False)) for i in range(3))


# -- components ------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node
    of its component. Alternating large-star and small-star rounds; each round
    is one written table, so lost executors cost one round at most."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
               "links")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")) \
            .select("x.u", "x.v").where("u <> v").distinct()
        e = stored(small, "links")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def simhash_components(docs: DataFrame, *, shingle: int = SHINGLE, bits: int = BITS,
                       segments: int = SEGMENTS) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits),
    ``component_id`` (smallest doc_id reachable over links), ``text_key``,
    ``root`` (the component's smallest fingerprint).

    NULL text is empty; texts without words have fingerprint zero and are
    linked like any other. A NULL doc_id counts as the largest. Repeated rows
    each give a row; an empty table gives none. Other columns are not read."""
    per_doc = stored(fingerprints(docs, shingle=shingle), "fingerprints")
    distinct = per_doc.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), bits=bits, segments=segments))
    named = distinct.join(roots, distinct.fp == roots.node, "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(ids, "root").select(F.col("fp").alias("p"), "component_id", "root")
    return per_doc.join(by_print, F.col("fp") == F.col("p")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key", "root")
