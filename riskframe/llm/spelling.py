"""Grouping of spelling variants by Bloom-guided neighbourhoods.

1. Tasks count words in bounded tables; Spark adds the counts. Words of at
   least ``MIN_LENGTH`` letters and ``MIN_COUNT`` occurrences are the vocabulary.
2. The vocabulary is sharded by length, each shard a blocked Bloom filter of
   512-bit blocks (eight 64-bit lanes, one bit of each set per word). A block
   is built by ``bit_or`` in Spark. Blocks of all shards have one address
   space; a round broadcasts at most ``ROUND_BLOCKS`` of them, so the broadcast
   has a fixed bound and a larger vocabulary takes more rounds.
3. Every word's neighbourhood is generated and probed: all deletions against
   the shard one letter shorter, and the replacements by a later letter of the
   vocabulary's alphabet against its own shard. (Insertions and replacements by
   an earlier letter are the same pairs seen from the other word.) Hashes are
   polynomial, so an edit costs a few operations on whole arrays and only
   positives become strings.
4. Positives are joined with the vocabulary, which removes the false ones. A
   filter has no false negatives, so no pair is lost.
5. A word's form is its near word of the largest count, if that is at least
   twice its own; roots follow by pointer jumping over written tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, rows, stored, text_or_empty

#: Letters in UTF-8: A-Z, a-z and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\xBF])+")
MIN_LENGTH, MIN_COUNT = 5, 3
#: A word's form occurs at least so many times as often.
RATIO = 2
#: One occurrence in so many (by crc32) loses a letter in the query's contract.
SLIP = 97
LANES = 8
WORDS_PER_BLOCK = 32
#: Blocks (64 bytes) in a broadcast: 32 MB.
ROUND_BLOCKS = 1 << 19
#: Words of this length or longer share a shard.
LONGEST_SHARD = 40
#: Different words that a task counts before it sends them on.
HOLD_WORDS = 300_000
#: Probes made together.
PROBES = 1 << 20

_BASE = 0x9E3779B97F4A7C15                     # odd, so it has an inverse modulo 2 ** 64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SALTS = np.array([2 * zlib.crc32(b"lane%d" % i) + 1 for i in range(LANES)], dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


# -- vocabulary ------------------------------------------------------------------------

def slipped(word: bytes, prefix: int) -> bytes:
    """The word without one letter if the contract's rule picks it; ``prefix``:
    crc32 of ``<doc_id>:``."""
    h = zlib.crc32(word, prefix)
    if h % SLIP:
        return word
    letters = word.decode()
    i = h % len(letters)
    return (letters[:i] + letters[i + 1:]).encode()


_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def count_words(docs: DataFrame, *, slips: bool = False, hold: int = HOLD_WORDS) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, of at least ``MIN_LENGTH``
    letters. ``slips`` takes a letter out of the occurrences that the
    contract's rule picks (none in a row with a NULL doc_id)."""
    def run(batches):
        table: Counter[bytes] = Counter()

        def out():
            for doc, text in rows(batches):
                found = Counter(RUN.findall(text.encode().lower()))        # bytes: lowers A-Z only
                if slips and doc is not None:
                    prefix = zlib.crc32(b"%d:" % doc)
                    for w, n in found.items():
                        if len(w) >= MIN_LENGTH:
                            table[slipped(w, prefix)] += n
                else:
                    table.update(found)
                if len(table) > hold:
                    yield from flush()
            yield from flush()

        def flush():
            for w, n in table.items():
                word = w.decode()
                if len(word) >= MIN_LENGTH:
                    yield word, n
            table.clear()

        return batches_of(out(), _COUNTS, size=16_384, weigh=lambda r: len(r[0]))

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# -- hashes ----------------------------------------------------------------------------

def _letters(words: list[str], length: int) -> np.ndarray:
    """Code points, words x length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), length).astype(np.uint64)


def _powers(length: int) -> np.ndarray:
    out = np.ones(length + 1, dtype=np.uint64)
    for i in range(1, length + 1):
        out[i] = out[i - 1] * np.uint64(_BASE)
    return out


def _finished(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Shards:
    """Where the blocks of every length's filter lie in the address space."""

    def __init__(self, counts: dict[int, int]):
        self.first = np.zeros(LONGEST_SHARD + 1, dtype=np.uint64)
        self.blocks = np.zeros(LONGEST_SHARD + 1, dtype=np.uint64)
        at = 0
        for shard in sorted(counts):
            n = -(-counts[shard] // WORDS_PER_BLOCK)
            self.first[shard], self.blocks[shard] = at, n
            at += n
        self.total = at

    def address(self, h: np.ndarray, length: int) -> np.ndarray | None:
        """Block addresses of finished hashes; None if the shard is empty."""
        s = min(length, LONGEST_SHARD)
        return self.first[s] + (h >> np.uint64(8)) % self.blocks[s] if self.blocks[s] else None


def _bits(h: np.ndarray) -> np.ndarray:
    """One bit in each of the lanes, hashes x lanes."""
    return np.uint64(1) << ((h[:, None] * _SALTS) >> np.uint64(58))


def _by_length(words: list[str], *more: list) -> Iterator[tuple[int, list[str], list[list]]]:
    size = np.array([len(w) for w in words])
    for length in np.unique(size).tolist():
        at = np.flatnonzero(size == length).tolist()
        yield length, [words[i] for i in at], [[m[i] for i in at] for m in more]


def _shard(word: Column) -> Column:
    return F.least(F.char_length(word), F.lit(LONGEST_SHARD))


# -- filters ---------------------------------------------------------------------------

_BLOCK = pa.schema([("address", pa.int64())] + [(f"b{j}", pa.int64()) for j in range(LANES)])
_BLOCK_DDL = "address long, " + ", ".join(f"b{j} long" for j in range(LANES))


def filter_blocks(words: DataFrame, shards: Shards) -> DataFrame:
    """(address, lanes) of every block that holds a word."""
    def run(batches):
        for b in batches:
            for length, some, _ in _by_length(b.column(0).to_pylist()):
                h = _finished((_letters(some, length) * _powers(length)[:length]).sum(axis=1, dtype=np.uint64))
                at, bits = shards.address(h, length), _bits(h)
                cols = [pa.array(at.view(np.int64))] + [pa.array(np.ascontiguousarray(bits[:, j]).view(np.int64)) for j in range(LANES)]
                yield pa.RecordBatch.from_arrays(cols, schema=_BLOCK)

    return words.select("word").mapInArrow(run, _BLOCK_DDL).groupBy("address") \
        .agg(*[F.bit_or(f"b{j}").alias(f"b{j}") for j in range(LANES)])


class Filter:
    """The blocks [start, start + len) of the address space."""

    def __init__(self, table: pa.Table, start: int, size: int):
        self.start = np.uint64(start)
        self.lanes = np.zeros((size, LANES), dtype=np.uint64)
        at = table.column("address").to_numpy() - start
        for j in range(LANES):
            self.lanes[at, j] = table.column(f"b{j}").to_numpy().view(np.uint64)

    def holds(self, shards: Shards, h: np.ndarray, length: int) -> np.ndarray:
        """Which finished hashes of words of ``length`` letters may be in this
        part of the filter."""
        ok = np.zeros(len(h), dtype=bool)
        address = shards.address(h, length)
        if address is None:
            return ok
        here = address - self.start                          # wraps round below the start
        some = np.flatnonzero(here < np.uint64(len(self.lanes)))
        for j in range(LANES):                               # most fail in the first lanes
            bit = (h[some] * _SALTS[j]) >> np.uint64(58)
            some = some[(self.lanes[here[some].astype(np.int64), j] >> bit) & np.uint64(1) == 1]
        ok[some] = True
        return ok


# -- neighbourhoods --------------------------------------------------------------------

def positives(words: list[str], length: int, part: Filter, shards: Shards, alphabet: np.ndarray) -> Iterator[tuple[int, str]]:
    """(index of a word, edited word) that the filter may hold: deletions, and
    replacements by a later letter. All words have ``length`` letters."""
    power = _powers(length)
    step = max(PROBES // max(length * len(alphabet), 1), 1)
    for a in range(0, len(words), step):
        some = words[a:a + step]
        code = _letters(some, length)
        terms = code * power[:length]
        whole = terms.sum(axis=1, dtype=np.uint64)
        upto = np.cumsum(terms, axis=1, dtype=np.uint64) - terms          # sum before each place
        after = whole[:, None] - upto - terms
        # a deletion in a stretch of one letter gives the same word at each place
        new = np.ones(code.shape, dtype=bool)
        new[:, 1:] = code[:, 1:] != code[:, :-1]
        i, at = np.nonzero(new)
        h = _finished(upto[i, at] + after[i, at] * np.uint64(_INVERSE))
        for k in np.flatnonzero(part.holds(shards, h, length - 1)).tolist():
            w, p = some[i[k]], at[k]
            yield a + int(i[k]), w[:p] + w[p + 1:]
        for p in range(length):
            i, c = np.nonzero(alphabet[None, :] > code[:, p:p + 1])
            h = _finished(whole[i] + (alphabet[c] - code[i, p]) * power[p])
            for k in np.flatnonzero(part.holds(shards, h, length)).tolist():
                w = some[i[k]]
                yield a + int(i[k]), w[:p] + chr(int(alphabet[c[k]])) + w[p + 1:]


_POSITIVE = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string())])


def near_pairs(words: DataFrame, *, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """(word, n, near, near_n), each pair of near words in both directions.
    ``words``: (word, n), a written table without repeats."""
    spark = words.sparkSession
    # at most LONGEST_SHARD rows, and one per letter
    shards = Shards({r["s"]: r["c"] for r in words.groupBy(_shard(F.col("word")).alias("s")).agg(F.count(F.lit(1)).alias("c")).collect()})
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), dtype=np.uint64)
    blocks = stored(filter_blocks(words, shards), "spelling-filter")

    def probe(shared):
        def run(batches):
            part = shared.value

            def out():
                for b in batches:
                    for length, some, (n,) in _by_length(b.column(0).to_pylist(), b.column(1).to_pylist()):
                        for i, near in positives(some, length, part, shards, alphabet):
                            yield some[i], n[i], near
            return batches_of(out(), _POSITIVE, size=16_384, weigh=lambda r: 2 * len(r[0]))
        return run

    found = None
    for start in range(0, shards.total, round_blocks):
        here = blocks.where(F.col("address").between(start, start + round_blocks - 1)).toArrow()     # at most round_blocks rows
        part = Filter(here, start, min(round_blocks, shards.total - start))
        shared = spark.sparkContext.broadcast(part)
        one = words.select("word", "n").mapInArrow(probe(shared), "word string, n long, near string")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "word string, n long, near string")
    exact = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    once = found.join(exact, "near")
    ways = F.array(F.struct("word", "n", "near", "near_n"),
                   F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return once.select(F.explode(ways).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form reached. Every form occurs
    more often than its word, so chains end; they halve in a round."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        next_ = at.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        moved = at.join(next_, F.col("root") == F.col("__w"), "left") \
            .select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved"))
        moved = stored(moved, "spelling-roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def spelling_groups(docs: DataFrame, *, slips: bool = False, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """One row per vocabulary word: ``word, form, root, n, n_near, form_n``.

    The vocabulary: runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z in lower
    case) of at least 5 letters that occur at least 3 times. Near: one letter
    inserted, deleted or replaced. ``form``: the near word of the largest count
    (ties: the smallest in code-point order) if that is at least twice the
    word's, else NULL; ``root``: the last form from the word on, itself if it
    has none; ``n_near``: near words; ``form_n``: the form's count or NULL.

    NULL and empty texts have no words. Repeated rows count as often as they
    occur. A NULL doc_id counts like any other, but ``slips`` (the contract's
    dropped letters, picked by doc_id and word) leaves its row alone. An empty
    table gives no row; other columns are not read."""
    words = stored(count_words(docs, slips=slips).where(F.col("n") >= MIN_COUNT), "spelling-words")
    pairs = near_pairs(words, round_blocks=round_blocks)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.first("n").alias("own"))
    near = stored(near.select(F.col("word").alias("__w"), "n_near",
                              F.when(-F.col("best.less") >= RATIO * F.col("own"), F.col("best.near")).alias("form"),
                              (-F.col("best.less")).alias("best_n")), "spelling-near")
    root = roots(near.where("form IS NOT NULL").select(F.col("__w").alias("word"), "form")).withColumnsRenamed({"word": "__r"})
    return words.join(near, F.col("word") == F.col("__w"), "left").join(root, F.col("word") == F.col("__r"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"))
