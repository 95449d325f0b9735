"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | context) = P(class | context) * P(part | class, context) * P(word | part).

* Classes. The ``HOT`` most frequent words (counts over all training text) are
  grouped by the texts they occur in (k-means over random sketches of those
  texts), each group is split into classes of about equal mass, and all other
  words, the unknown one included, form the last class. A class but the last
  has ``PARTS`` parts of about equal mass.
* P(class | context) is a softmax over summed weight rows of hashed features:
  the previous word (bigram), the two previous words (trigram) and the word
  before the previous one (skip).
* P(part | class, context) is a softmax as well, over one weight row, that of
  the previous word and the class, and the parts' shares of the class.
* P(word | part) is (count + 1) / (sum over the part), so the model is a
  distribution over the same words as the unigram base: the V known ones and
  one unknown.

Training: in each round every worker takes gradient steps (row-wise Adagrad,
numpy mini-batches) over all its training tokens, from the common weights;
weight rows are then averaged, weighted by how often each worker touched them.
A worker is one or more input partitions with at least as many bytes of text as
a model has, and sends touched rows only, so the updates are no larger than the
text. Sums are made by Spark in blocks of rows; the model that reaches the
driver has a fixed size. Words beyond the hot ones are never broadcast:
texts look their counts up in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

HOT = 1 << 18
CLASSES = 24
PARTS = 16
GROUPS = 8
#: Weight rows per feature.
BIGRAM, TRIGRAM, SKIP = 1 << 15, 1 << 15, 1 << 14
ROWS = BIGRAM + TRIGRAM + SKIP
PART_ROWS = 1 << 15
ROUNDS = 1
RATE = 0.1
BATCH = 16_384
#: Bytes of text that are turned into token arrays at a time.
CHUNK_BYTES = 4 << 20
#: Numbers per word sketch.
DIMS = 8
#: Different words that a task holds before it sends their counts on.
HOLD_WORDS = 600_000
BLOCK_ROWS = 1024

#: Keys (64-bit hashes) of the end of a text and of what is before its start.
END = np.uint64(xxhash.xxh64_intdigest(b"", 1))
START = np.uint64(xxhash.xxh64_intdigest(b"", 2))


def held_out(doc_id: Column, fold: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % fold == rest, F.lit(False))


# -- token arrays ----------------------------------------------------------------------

@dataclass
class Tokens:
    """Tokens of some texts: ``ids`` into ``keys``; text i is
    ``ids[starts[i]:starts[i + 1]]`` and ends with the end token."""
    ids: np.ndarray
    keys: np.ndarray
    starts: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def tokens_of(texts: pa.Array) -> Tokens:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary())
    _, edges, data = words.buffers()
    edges = np.frombuffer(edges, dtype=np.int64)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = data.to_pybytes() if data is not None else b""
    ids = coded.indices.to_numpy(zero_copy_only=False)
    text_of = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    empty = np.flatnonzero(np.diff(edges) == 0)
    if len(empty):                                    # an empty piece at either end of a text
        real = ids != empty[0]
        ids, text_of = ids[real], text_of[real]
    digest, at = xxhash.xxh64_intdigest, edges.tolist()
    keys = np.array([digest(data[i:j]) for i, j in zip(at, at[1:])] + [int(END)], dtype=np.uint64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(text_of, minlength=len(texts)) + 1)])
    out = np.full(starts[-1], len(words), dtype=np.int32)
    inner = np.ones(starts[-1], dtype=bool)
    inner[starts[1:] - 1] = False
    out[inner] = ids
    return Tokens(out, keys, starts)


def chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where their texts (column number ``text``) reach ``CHUNK_BYTES``."""
    for b in batches:
        if not b.num_rows:
            continue
        at = np.cumsum(pc.binary_length(b.column(text)).to_numpy(zero_copy_only=False)) // CHUNK_BYTES
        edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
        for a, e in zip(edges, edges[1:]):
            yield b.slice(a, e - a)


# -- counts ----------------------------------------------------------------------------

_COUNTS = pa.schema([("w", pa.int64()), ("n", pa.int64())] + [(f"s{j}", pa.float32()) for j in range(DIMS)])
_COUNTS_DDL = "w long, n long, " + ", ".join(f"s{j} float" for j in range(DIMS))


def _signs(keys: np.ndarray) -> np.ndarray:
    """DIMS signs per key."""
    return (((keys[:, None] >> np.arange(8, 8 + DIMS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1)


def _added(keys, counts, sketches):
    uniq, inverse = np.unique(keys, return_inverse=True)
    n = np.bincount(inverse, weights=counts, minlength=len(uniq)).astype(np.int64)
    s = np.stack([np.bincount(inverse, weights=sketches[:, j], minlength=len(uniq)) for j in range(DIMS)], axis=1)
    return uniq, n, s.astype(np.float32)


def _count_words(batches):
    """Counts of words and, where a task sees one three times or more, the sum
    of the sketches of its texts (the mean signs of their words)."""
    def emit(keys, n, s):
        for a in range(0, len(keys), 65536):
            z = slice(a, a + 65536)
            rare = n[z] < 3
            cols = [pa.array(keys[z].view(np.int64)), pa.array(n[z])]
            cols += [pa.array(s[z, j], pa.float32(), mask=rare) for j in range(DIMS)]
            yield pa.RecordBatch.from_arrays(cols, schema=_COUNTS)

    held: list[tuple] = []
    for b in chunks(batches, 0):
        t = tokens_of(b.column(0))
        signs = _signs(t.keys)
        sizes = np.diff(t.starts)[:, None]
        counts = np.bincount(t.ids, minlength=len(t.keys))
        text_of = t.text_of
        sketch = np.empty((len(t.keys), DIMS), dtype=np.float32)
        for j in range(DIMS):
            mean = np.add.reduceat(signs[t.ids, j], t.starts[:-1]) / sizes[:, 0]
            sketch[:, j] = np.bincount(t.ids, weights=mean[text_of], minlength=len(t.keys))
        seen = counts > 0
        held.append((t.keys[seen], counts[seen], sketch[seen]))
        if sum(len(h[0]) for h in held) > HOLD_WORDS:
            held = [_added(*(np.concatenate(c) for c in zip(*held)))]
            if len(held[0][0]) > HOLD_WORDS // 2:
                yield from emit(*held[0])
                held = []
    if held:
        yield from emit(*_added(*(np.concatenate(c) for c in zip(*held))))


# -- the model -------------------------------------------------------------------------

@dataclass
class Model:
    """Fixed-size parts that tasks need."""
    hot: np.ndarray           # sorted keys (uint64) of the hot words
    hot_class: np.ndarray     # their classes
    hot_count: np.ndarray     # their training counts
    hot_part: np.ndarray      # their parts
    mass: np.ndarray          # CLASSES x PARTS: sum of count + 1; part 0 of the last class: all other words and the unknown one
    weights: np.ndarray       # ROWS x CLASSES
    bias: np.ndarray
    part_weights: np.ndarray  # PART_ROWS x PARTS

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys stand among the hot words, and whether they are hot."""
        if not len(self.hot):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.hot, keys), len(self.hot) - 1)
        return at, self.hot[at] == keys

    def classes(self, keys: np.ndarray) -> np.ndarray:
        at, hot = self.places(keys)
        out = np.full(len(keys), CLASSES - 1, dtype=np.int64)
        out[hot] = self.hot_class[at[hot]]
        return out

    def parts(self, keys: np.ndarray) -> np.ndarray:
        at, hot = self.places(keys)
        out = np.zeros(len(keys), dtype=np.int64)
        out[hot] = self.hot_part[at[hot]]
        return out

    @property
    def part_bias(self) -> np.ndarray:
        """Log shares of the parts within their class; empty ones get next to nothing."""
        share = self.mass / np.maximum(self.mass.sum(axis=1, keepdims=True), 1e-9)
        return np.where(self.mass > 0, np.log(np.maximum(share, 1e-12)), -30.0).astype(np.float32)


def previous(t: Tokens) -> np.ndarray:
    """The key before every token."""
    key = t.keys[t.ids]
    one = np.empty_like(key)
    one[1:] = key[:-1]
    one[t.starts[:-1]] = START
    return one


def part_rows(before: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Weight row of the part softmax: previous word and class."""
    mixed = (before + classes.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(40)) & np.uint64(PART_ROWS - 1)).astype(np.int32)


def features(t: Tokens) -> np.ndarray:
    """Weight rows (tokens x 3) of every token's context."""
    key = t.keys[t.ids]
    one, two = previous(t), np.empty_like(key)
    two[2:] = key[:-2]
    first = t.starts[:-1]
    two[first] = START
    second = first[np.diff(t.starts) > 1] + 1
    two[second] = START
    mixed = (one * np.uint64(0x9E3779B97F4A7C15) + two * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    return np.stack([(one >> np.uint64(20)) & np.uint64(BIGRAM - 1),       # powers of two
                     (mixed & np.uint64(TRIGRAM - 1)) + np.uint64(BIGRAM),
                     ((two >> np.uint64(30)) & np.uint64(SKIP - 1)) + np.uint64(BIGRAM + TRIGRAM)], axis=1).astype(np.int32)


def softmax(z: np.ndarray) -> np.ndarray:
    """By row. One maximum for all rows is much faster than one for each; rows
    too far below it are done again with their own."""
    out = np.exp(z - z.max()) if len(z) else z
    total = out @ np.ones(z.shape[1], dtype=z.dtype)
    far = np.flatnonzero(total < 1e-25)
    if len(far):
        out[far] = np.exp(z[far] - z[far].max(axis=1, keepdims=True))
        total[far] = out[far].sum(axis=1)
    out /= total[:, None]
    return out


def class_probabilities(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    z = weights[f[:, 0]]
    z += weights[f[:, 1]]
    z += weights[f[:, 2]]
    z += bias
    return softmax(z)


def part_probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Tokens x PARTS; ``bias``: by class."""
    z = weights[rows]
    z += bias[classes]
    return softmax(z)


def gradient_steps(model: Model, tokens: Iterator[Tokens], seed: int = 0, rate: float = RATE):
    """Adagrad over the tokens; the weights, bias, how often rows were used, the
    tokens; then the part weights and how often their rows were used."""
    w, bias = model.weights.copy(), model.bias.copy()
    v, part_bias = model.part_weights.copy(), model.part_bias
    v_seen, v_past = np.zeros(PART_ROWS, dtype=np.float32), np.ones(PART_ROWS, dtype=np.float32)
    seen, past = np.zeros(ROWS, dtype=np.float32), np.ones(ROWS, dtype=np.float32)
    past_bias, total = 1.0, 0
    first = (0, BIGRAM, BIGRAM + TRIGRAM)
    rng = np.random.default_rng(seed)
    for t in tokens:
        f, y, part = features(t), model.classes(t.keys)[t.ids], model.parts(t.keys)[t.ids]
        p_rows = part_rows(previous(t), y)
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            pick = order[a:a + BATCH]
            rows = f[pick]
            g = class_probabilities(w, bias, rows)
            g[np.arange(len(pick)), y[pick]] -= 1
            for k in range(3):              # 16-bit keys: numpy sorts them by radix
                own = rows[:, k] - first[k]
                by_row = np.argsort(own.astype(np.uint16), kind="stable")
                in_order = rows[by_row, k]
                start = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]])
                ids, times = in_order[start], np.diff(np.r_[start, len(in_order)])
                step = np.add.reduceat(g[by_row], start, axis=0)
                past[ids] += np.einsum("ij,ij->i", step, step) / CLASSES
                w[ids] -= (rate / np.sqrt(past[ids]))[:, None] * step
                seen[ids] += times
            up = g.sum(axis=0)
            past_bias += float((up * up).mean())
            bias -= rate / math.sqrt(past_bias) * up
            total += len(pick)
            inner = pick[y[pick] < CLASSES - 1]
            if len(inner):
                own = p_rows[inner]
                g = part_probabilities(v, part_bias, own, y[inner])
                g[np.arange(len(inner)), part[inner]] -= 1
                by_row = np.argsort(own.astype(np.uint16), kind="stable")
                in_order = own[by_row]
                start = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]])
                ids = in_order[start]
                step = np.add.reduceat(g[by_row], start, axis=0)
                v_past[ids] += np.einsum("ij,ij->i", step, step) / PARTS
                v[ids] -= (rate / np.sqrt(v_past[ids]))[:, None] * step
                v_seen[ids] += np.diff(np.r_[start, len(in_order)])
    return w, bias, seen, total, v, v_seen


_UPDATE = pa.schema([("block", pa.int32()), ("slot", pa.int32()), ("rows", pa.binary()), ("part", pa.binary())])
_UPDATE_DDL = "block int, slot int, rows binary, part binary"
#: Slots in which a block is summed before its slots are, where there are more
#: workers: no task reads a block of every worker.
SLOTS = 64
#: Bytes that a token of a text takes, about; and those of a model.
TOKEN_BYTES = 6
MODEL_BYTES = 4 * (ROWS * (CLASSES + 1) + PART_ROWS * (PARTS + 1))


def workers(tokens: int) -> int:
    """Workers of a round: each has at least a model's bytes of text."""
    return max(tokens * TOKEN_BYTES // MODEL_BYTES, 1)


def _steps(shared, fold_seed: int):
    def run(batches):
        from pyspark import TaskContext

        w, bias, seen, total, v, v_seen = gradient_steps(shared.value, (tokens_of(b.column(0)) for b in chunks(batches, 0)),
                                                               seed=fold_seed + TaskContext.get().partitionId())
        if not total:
            return
        slot = TaskContext.get().partitionId() % SLOTS
        for number, weights, times in ((0, w, seen), (PART_BLOCK, v, v_seen)):
            for i, first in enumerate(range(0, len(weights), BLOCK_ROWS), number):
                used = np.flatnonzero(times[first:first + BLOCK_ROWS])
                if len(used):
                    n = times[first + used, None]
                    yield _update(i, slot, used, np.hstack([weights[first + used] * n, n]))
        yield _update(BIAS_BLOCK, slot, np.zeros(1, dtype=int), np.r_[bias * total, total][None, :])
    return run


#: Numbers of the blocks after those of the class weights.
BIAS_BLOCK = ROWS // BLOCK_ROWS
PART_BLOCK = BIAS_BLOCK + 1


def _update(block: int, slot: int, rows: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """Some rows of a block, each followed by how often it was used."""
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([slot], pa.int32()),
                                       pa.array([rows.astype("<u2").tobytes()], pa.binary()),
                                       pa.array([x.astype("<f4").tobytes()], pa.binary())], schema=_UPDATE)


def _rows_of(rows: bytes, part: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(rows, dtype="<u2").astype(int)
    return at, np.frombuffer(part, dtype="<f4").reshape(len(at), -1)


def _sum_blocks(batches):
    """Sums of the blocks that were dealt to this task."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, rows, part in zip(*(b.column(c).to_pylist() for c in (0, 2, 3))):
            at, v = _rows_of(rows, part)
            sums.setdefault(i, np.zeros((BLOCK_ROWS, v.shape[1])))[at] += v
    for i, v in sums.items():
        used = np.flatnonzero(v[:, -1])
        yield _update(i, 0, used, v[used])


def _grouped(sketch: np.ndarray, count: np.ndarray, groups: int, tries: int = 4) -> np.ndarray:
    """Group of each hot word: k-means++ over mean sketches, the best of some
    starts, fitted on the 20,000 most frequent words."""
    if not len(count):
        return np.zeros(0, dtype=np.int64)
    y = sketch[np.argsort(-count, kind="stable")[:20_000]]
    rng = np.random.default_rng(7)
    far = lambda x, c: ((x[:, None, :] - c[None]) ** 2).sum(-1)
    best = (math.inf, y[:1])
    for _ in range(tries):
        c = y[:1]
        while len(c) < groups and (d := far(y, c).min(axis=1)).any():
            c = np.vstack([c, y[rng.choice(len(y), p=d / d.sum())]])
        for _ in range(15):
            near = far(y, c).argmin(axis=1)
            c = np.stack([y[near == g].mean(axis=0) if (near == g).any() else c[g] for g in range(len(c))])
        best = min(best, (float(far(y, c).min(axis=1).sum()), c), key=lambda b: b[0])
    return np.concatenate([far(x, best[1]).argmin(axis=1) for x in np.array_split(sketch, max(len(sketch) // 8192, 1))])


def _balanced(group: np.ndarray, count: np.ndarray, classes: int) -> np.ndarray:
    """Classes of about equal mass within groups; groups get classes by mass."""
    mass = np.bincount(group, weights=count + 1.0) if len(group) else np.zeros(0)
    share = np.zeros(len(mass), dtype=np.int64)
    share[mass > 0] = 1
    while share.sum() < classes and len(mass):
        share[np.argmax(mass / np.maximum(share, 1e-9) * (mass > 0))] += 1
    first = np.cumsum(share) - share
    loads, out = np.zeros(classes), np.zeros(len(group), dtype=np.int64)
    for i in np.argsort(-count, kind="stable"):
        a, n = first[group[i]], share[group[i]]
        out[i] = a + loads[a:a + n].argmin()
        loads[out[i]] += count[i] + 1
    return out


def _parts(cls: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Parts of about equal mass within the classes."""
    loads, out = np.zeros((CLASSES, PARTS)), np.zeros(len(cls), dtype=np.int64)
    for i in np.argsort(-count, kind="stable"):
        mine = loads[cls[i]]
        out[i] = mine.argmin()
        mine[out[i]] += count[i] + 1
    return out


def hot_words(types: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The most frequent words, at most ``limit``, by a count threshold taken
    from a histogram of a few hundred rows (no sort of all words)."""
    bucket = F.floor(F.log2(F.col("n").cast("double")) * 16)
    at, threshold = 0, None
    for r in sorted(types.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low")).collect(),
                    key=lambda r: -r["b"]):
        if at + r["c"] > limit:
            break
        at, threshold = at + r["c"], r["low"]
    least = threshold if threshold is not None else (1 << 62)
    return types.where(F.col("n") >= least), least


def fit(texts: DataFrame, *, hot: int = HOT, rounds: int = ROUNDS):
    """Fit on the column ``text`` of ``texts``. Returns the model, the table of
    all words (w, n), the count from which on words are hot, N and V."""
    spark = texts.sparkSession
    sums = [F.sum(F.col(f"s{j}").cast("double")).alias(f"s{j}") for j in range(DIMS)]
    types = stored(texts.select("text").mapInArrow(_count_words, _COUNTS_DDL).groupBy("w").agg(F.sum("n").alias("n"), *sums),
                   "lm-words")
    row = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    frequent, least = hot_words(types, hot)
    got = frequent.toArrow()                              # at most `hot` rows of numbers
    keys = got.column("w").to_numpy().view(np.uint64) if got.num_rows else np.zeros(0, dtype=np.uint64)
    order = np.argsort(keys)
    keys, count = keys[order], (got.column("n").to_numpy() if got.num_rows else np.zeros(0, dtype=np.int64))[order]
    sketch = np.stack([np.nan_to_num(got.column(f"s{j}").to_numpy(zero_copy_only=False).astype(float)) for j in range(DIMS)],
                      axis=1)[order] / np.maximum(count, 1)[:, None] if got.num_rows else np.zeros((0, DIMS))
    cls = _balanced(_grouped(sketch, count, GROUPS), count, CLASSES - 1)
    part = _parts(cls, count)
    by_part = np.bincount(cls * PARTS + part, weights=count + 1.0, minlength=CLASSES * PARTS).reshape(CLASSES, PARTS)
    by_part[CLASSES - 1, 0] = (row["n"] - count.sum()) + (row["v"] - len(keys)) + 1.0
    mass = by_part.sum(axis=1)
    bias = np.where(mass > 0, np.log(np.maximum(mass, 1e-9)), -30.0 + math.log(mass.max())) - math.log(mass.sum())
    model = Model(keys, cls.astype(np.int16), count, part.astype(np.int16), by_part, np.zeros((ROWS, CLASSES), dtype=np.float32),
                  bias.astype(np.float32), np.zeros((PART_ROWS, PARTS), dtype=np.float32))
    for r in range(rounds if row["n"] else 0):
        shared = spark.sparkContext.broadcast(model)
        some = workers(row["n"])
        updates = texts.select("text").coalesce(some).mapInArrow(_steps(shared, 1000 * r), _UPDATE_DDL)
        for deal in (["block", "slot"], ["block"])[some <= SLOTS:]:
            updates = updates.repartition(*deal).mapInArrow(_sum_blocks, _UPDATE_DDL)
        summed = updates.toArrow()                        # at most ROWS x (CLASSES + 1) numbers
        for i, rows, part in zip(*(summed.column(c).to_pylist() for c in ("block", "rows", "part"))):
            at, v = _rows_of(rows, part)
            if i == BIAS_BLOCK:
                model.bias = (v[0, :-1] / v[0, -1]).astype(np.float32)
            elif i >= PART_BLOCK:
                model.part_weights[(i - PART_BLOCK) * BLOCK_ROWS + at] = v[:, :-1] / v[:, -1:]
            else:
                model.weights[i * BLOCK_ROWS + at] = v[:, :-1] / v[:, -1:]
    return model, types.select("w", "n"), least, row["n"], row["v"]


# -- scores ----------------------------------------------------------------------------

_SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base", pa.float64()), ("score", pa.float64()), ("rest", pa.list_(pa.int64()))])
_SCORED_DDL = "row long, doc_id long, n_tokens long, n_known long, base double, score double, rest array<long>"


def _score_texts(shared):
    def run(batches):
        from pyspark import TaskContext

        model: Model = shared.value
        row = TaskContext.get().partitionId() << 32
        per_part, part_bias = np.log10(np.maximum(model.mass, 1e-300)), model.part_bias
        hot_log = np.log10(model.hot_count + 1.0)
        for b in chunks(batches, 1):
            t = tokens_of(b.column(1))
            n = b.num_rows
            at, hot = model.places(t.keys)
            log_count = np.zeros(len(t.keys))
            log_count[hot] = hot_log[at[hot]]
            cls = model.classes(t.keys)
            f = features(t)
            chosen = np.empty(len(t.ids))
            y, part = cls[t.ids], model.parts(t.keys)[t.ids]
            p_rows = part_rows(previous(t), y)
            for a in range(0, len(y), BATCH):
                z = slice(a, a + BATCH)
                p = class_probabilities(model.weights, model.bias, f[z])
                chosen[z] = p[np.arange(len(p)), y[z]]
                inner = np.flatnonzero(y[z] < CLASSES - 1) + a
                q = part_probabilities(model.part_weights, part_bias, p_rows[inner], y[inner])
                chosen[inner] *= q[np.arange(len(q)), part[inner]]
            first = t.starts[:-1]
            logs = log_count[t.ids]
            base = np.add.reduceat(logs, first)
            score = base + np.add.reduceat(np.log10(np.maximum(chosen, 1e-300)) - per_part[y, part], first)
            is_hot = hot[t.ids]
            known = np.add.reduceat(is_hot.astype(np.int64), first)
            sizes = np.diff(t.starts)
            left = t.keys[t.ids[~is_hot]].view(np.int64)
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes - known)]), pa.int32()), pa.array(left))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), b.column(0), pa.array(sizes), pa.array(known), pa.array(base),
                 pa.array(score), rest], schema=_SCORED)
            row += n
    return run


def score_texts(docs: DataFrame, *, fold: int = 7, rest: int = 2, hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score`` (log10 probabilities of the whole text by the unigram
    base and by the model).

    NULL text is empty (one token, the end). A NULL doc_id is never held out.
    Repeated rows each give a row and count as often as they occur; an empty
    table gives none. Without training text every token has probability 1 in
    both (only the unknown word is left)."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    model, types, least, n, v = fit(src.where(~held_out(F.col("doc_id"), fold, rest)), hot=hot, rounds=rounds)
    shared = spark.sparkContext.broadcast(model)
    scored = stored(src.mapInArrow(_score_texts(shared), _SCORED_DDL), "lm-scores")
    # words beyond the hot ones: their counts come by a join, never by broadcast
    rare = scored.select("row", F.explode("rest").alias("w")).groupBy("row", "w").agg(F.count(F.lit(1)).alias("times"))
    counted = rare.join(types.where(F.col("n") < least), "w") \
        .groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"))
    j = scored.join(counted, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return j.select(
        "doc_id", held_out(F.col("doc_id"), fold, rest).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("score") + logs).alias("score"))
