"""ML-5/6: first-order boosted trees, the kinds ``gbt`` and ``gbt_deep``.

The trees of Spark ML's ``GBTClassifier`` (log loss, variance impurity, cuts at
sampled quantiles, rows sampled by partition, a subset of features per node),
grown so that they scale with rows. A row is a byte per *source* column: the
0/1 features of a category are told from its level's number, so the sums of one
column serve all of them. A tree takes a job per level: tasks add up their rows
per (node, column, bin), and only these sums, whose number does not depend on
the rows, reach the driver. Several models (folds) are grown side by side in
the same jobs. Random numbers are those of ``GBTClassifier`` with the same
seed, so the trees are the same up to the order of sums."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .boosting import Booster, Tree, TreeParams
from .features import Preprocessor
from .random_bits import JavaRandom, XorShift

#: Bins of a numeric column, and rows sampled to find their cuts (at least).
BINS, SAMPLE = 32, 10_000
#: Rows of a block: what a task holds in memory at a time.
BLOCK = 1 << 16
#: Rows of a task, at most on average.
TASK_ROWS = 1 << 20
#: Trees whose values are added to the stored margin at a time, and trees after
#: which margins are written, so that lineage stays short.
PENDING, COMMIT = 5, 25
#: Two counts in one number: rows, and rows of class 1 times this.
PACK = 1 << 31
#: Tasks whose sums go to the driver one by one.
MERGED = 64
#: Depth up to which nodes are numbered as a heap.
MAX_DEPTH = 12


@dataclass
class Columns:
    """Source columns of the features: per numeric one its cuts, then the
    levels of each categorical one (a feature per level but the first)."""
    cuts: list[np.ndarray]
    levels: list[list[str]]

    def __post_init__(self):
        self.sizes = [len(c) + 1 for c in self.cuts] + [len(v) + 1 for v in self.levels]      # the last code: a level unseen in training
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.where = [(j, None) for j in range(len(self.cuts))]                                 # feature -> (column, level)
        self.where += [(len(self.cuts) + j, k) for j, v in enumerate(self.levels) for k in range(1, len(v))]
        self.dtype = np.uint8 if max(self.sizes, default=1) <= 256 else np.uint16

    def codes(self, numbers: list[np.ndarray], texts: list[pa.Array]) -> np.ndarray:
        """Columns x rows."""
        out = np.empty((len(self.sizes), len(numbers[0]) if numbers else len(texts[0])), dtype=self.dtype)
        for j, (x, cut) in enumerate(zip(numbers, self.cuts)):
            out[j] = np.searchsorted(cut, x, side="left")
        for j, (x, v) in enumerate(zip(texts, self.levels), len(self.cuts)):
            at = pc.fill_null(pc.index_in(x.cast(pa.string()), value_set=pa.array(v, pa.string())), len(v))
            out[j] = at.to_numpy(zero_copy_only=False)
        return out


def source(df: DataFrame, prep: Preprocessor) -> list:
    """The prepared numbers and filled categories that :class:`Columns` codes."""
    x = prep.numbers() + prep.filled()
    return [c.alias(f"__s{i}") for i, c in enumerate(x)]


def _sources(batch: pa.RecordBatch, first: int, numeric: int) -> tuple[list[np.ndarray], list[pa.Array]]:
    c = batch.columns[first:]
    return [a.to_numpy(zero_copy_only=False) for a in c[:numeric]], c[numeric:]


# -- trees -----------------------------------------------------------------------------

@dataclass
class Plan:
    """A tree of which the first levels are known, by heap number: ``column``,
    and ``right`` (node, code) -> goes right. Nodes that are not split send
    every row left."""
    depth: int
    column: np.ndarray
    right: np.ndarray

    def nodes(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """Heap numbers after ``levels`` splits (of leaves: their leftmost
        place below)."""
        n = codes.shape[1]
        flat, width, right = codes.reshape(-1), self.right.shape[1], self.right.reshape(-1)
        at = np.ones(n, dtype=np.int64)
        rows = np.arange(n, dtype=np.int64)
        start = self.column * n
        for _ in range(levels):
            code = flat.take(start.take(at) + rows)
            go = right.take(at * width + code)
            at <<= 1
            at += go
        return at


def _plan(columns: Columns, depth: int, splits: dict[int, tuple[int, int]]) -> Plan:
    """``splits``: heap number -> (feature, cut)."""
    size = 1 << depth
    plan = Plan(depth, np.zeros(size, dtype=np.int64), np.zeros((size, max(columns.sizes, default=1)), dtype=np.uint8))
    for node, (f, cut) in splits.items():
        c, level = columns.where[f]
        plan.column[node] = c
        if level is None:
            plan.right[node, cut + 1:] = 1
        else:
            plan.right[node, level] = 1
    return plan


@dataclass
class Node:
    """``total``: weight x residual; ``gain`` is times the weight."""
    heap: int
    weight: float = 0.0
    total: float = 0.0
    rows: int = 0
    split: tuple[int, int] | None = None
    gain: float = 0.0

    @property
    def prediction(self) -> float:
        return self.total / self.weight if self.weight else 0.0


class GradientTrees(Booster):
    """Fitted trees. Values at leaves are doubled, which makes the margin the
    log-odds, as in the other boosted models; ``gain`` is times the weight."""

    def plans(self, columns: Columns) -> list[tuple[Plan, np.ndarray, int]]:
        out = []
        for t in self.trees:
            depth = max(int(t.heap.max()).bit_length() - 1, 0)
            inner = t.feature >= 0
            plan = _plan(columns, depth, {int(h): (int(f), int(c)) for h, f, c in zip(t.heap[inner], t.feature[inner], t.cut[inner])})
            value = np.zeros(2 << depth)
            for h, v in zip(t.heap[~inner].tolist(), t.value[~inner].tolist()):
                value[h << (depth + 1 - h.bit_length())] = v
            out.append((plan, value, depth))
        return out


def score_gradient_trees(df: DataFrame, prep: Preprocessor, model: GradientTrees, out: str) -> DataFrame:
    """SC-1: adds the probability of class 1."""
    columns = Columns(model.edges[:len(prep.numeric)], [prep.vocab[c] for c in prep.categorical])
    n, numeric = len(df.columns), len(prep.numeric)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` double"

    def run(batches):
        plans = model.plans(columns)
        for b in batches:
            codes = columns.codes(*_sources(b, n, numeric))
            margin = np.full(codes.shape[1], model.start)
            for plan, value, depth in plans:
                margin += value.take(plan.nodes(codes, depth))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(1.0 / (1.0 + np.exp(-margin)))], names=[*b.schema.names[:n], out])

    return df.select("*", *source(df, prep)).mapInArrow(run, ddl)


# -- cuts ------------------------------------------------------------------------------

def sampled_values(x: DataFrame, numeric: int, fraction: float, seed: int) -> list[tuple[dict[float, float], int]]:
    """Per numeric column weight by value other than 0, and how many rows, over
    a sample; its rows, about ``SAMPLE``, reach the driver. ``x``: weight, then
    the numeric columns."""
    if fraction < 1.0:
        draw = XorShift.of(seed).next_int()

        def run(batches):
            rng = JavaRandom(draw)
            part = TaskContext.get().partitionId()
            for _ in range(part):
                rng.next_long()
            state = XorShift.of(rng.next_long())
            yield from (b.take(pa.array(at)) for b, at in _picked(batches, state, fraction) if len(at))
        x = x.mapInArrow(run, ", ".join(f"`{c}` double" for c in x.columns))
    t = x.toArrow()
    w = t.column(0).to_numpy()
    out = []
    for j in range(numeric):
        v = t.column(1 + j).to_numpy()
        own: dict[float, float] = {}
        for value, weight in zip(v[v != 0.0].tolist(), w[v != 0.0].tolist()):
            own[value] = own.get(value, 0.0) + weight
        out.append((own, int((v != 0.0).sum())))
    return out


def _picked(batches, state: XorShift, fraction: float):
    """(batch, positions) of a Bernoulli sample: by gaps where it is sparse."""
    if fraction > 0.4:
        for b in batches:
            yield b, np.flatnonzero(state.doubles(b.num_rows) <= fraction)
        return
    base = math.log1p(-fraction)
    gap = lambda: int(math.log(max(state.next_double(), 5e-11)) / base)
    drop = gap()
    for b in batches:
        at = []
        while drop < b.num_rows:
            at.append(drop)
            drop += gap() + 1
        drop -= b.num_rows
        yield b, np.array(at, dtype=np.int64)


def cuts_of(values: dict[float, float], count: int, expected: float, bins: int) -> np.ndarray:
    """Cuts between sampled values, at most ``bins`` - 1, at about equal
    weights. ``expected``: weight of the sample, of which what ``values`` lacks
    belongs to 0."""
    if not values:
        return np.empty(0)
    lacking = expected - sum(values.values())
    if lacking > 2.0 ** -52 * count * 100:
        values = {**values, 0.0: lacking}
    items = sorted(values.items())
    if len(items) <= bins:
        return np.array([(a + b) / 2.0 for (a, _), (b, _) in zip(items, items[1:])])
    stride = expected / bins
    out, current, target = [], items[0][1], stride
    for (a, _), (b, w) in zip(items, items[1:]):
        before, current = current, current + w
        if abs(before - target) < abs(current - target):
            out.append((a + b) / 2.0)
            target += stride
    return np.array(out)


# -- growing ---------------------------------------------------------------------------

@dataclass
class Model:
    """A model while it grows: ``weights`` of the classes 0 and 1."""
    columns: Columns
    weights: np.ndarray
    rows: int
    features: list[str]
    blocks: DataFrame

    @property
    def unit(self) -> float:
        """What residuals are counted in: a power of two by which the sums of
        all rows fit 64 bits and those of a block a double."""
        most = 16 * max(self.weights.max(), 1.0)                 # weight x residual ** 2
        return 2.0 ** -min(62 - math.ceil(math.log2(most * self.rows)), 52 - math.ceil(math.log2(most * BLOCK)))


def _prepared(train: DataFrame, prep: Preprocessor, label: str, weight: str | None, number: int, seed: int) -> Model:
    """Cuts from a sample, then the coded rows in blocks, written."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    found = train.groupBy(y.alias("y"), w.alias("w")).agg(F.count(F.lit(1)).alias("n")).limit(4).collect()
    if any(r["y"] not in (0.0, 1.0) for r in found):
        raise ValueError(f"labels must be 0 or 1: {label}")
    if len({r["y"] for r in found}) < len(found):
        raise ValueError("rows of a class must weigh the same")
    rows, total = sum(r["n"] for r in found), sum(r["n"] * r["w"] for r in found)
    if not rows:
        raise ValueError("no training rows")
    weights = np.ones(2)
    for r in found:
        weights[int(r["y"])] = r["w"]
    numeric = len(prep.numeric)
    bins = min(BINS, rows)
    needed = max(bins * bins, SAMPLE)
    fraction = needed / rows if needed < rows else 1.0
    src = source(train, prep)
    sample = sampled_values(train.select(w.alias("w"), *src[:numeric]), numeric, fraction, seed)
    columns = Columns([cuts_of(v, n, fraction * total, bins) for v, n in sample], [prep.vocab[c] for c in prep.categorical])
    schema = pa.schema([("model", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("rows", pa.int32()),
                        ("y", pa.large_binary()), ("codes", pa.large_binary())])

    def run(batches):
        part, block, held, have = TaskContext.get().partitionId(), 0, [], 0

        def packed(ys, cs):
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (number, part, block, len(ys))),
                                               pa.array([ys.tobytes()], pa.large_binary()), pa.array([cs.tobytes()], pa.large_binary())], schema=schema)
        for b in batches:
            held.append((b.column(0).to_numpy().astype(np.uint8), columns.codes(*_sources(b, 1, numeric))))
            have += b.num_rows
            while have >= BLOCK:
                ys, cs = (np.concatenate([h[j] for h in held], axis=-1) for j in range(2))
                yield packed(ys[:BLOCK], np.ascontiguousarray(cs[:, :BLOCK]))
                held, have, block = [(ys[BLOCK:], cs[:, BLOCK:])], have - BLOCK, block + 1
        if have:
            ys, cs = (np.concatenate([h[j] for h in held], axis=-1) for j in range(2))
            yield packed(ys, np.ascontiguousarray(cs))

    blocks = cut_lineage(train.select(y, *src).mapInArrow(run, "model int, part int, block int, rows int, y binary, codes binary"))
    return Model(columns, weights, rows, prep.feature_cols, blocks)


def _margins(margin: bytes, trees: list, codes: np.ndarray) -> np.ndarray:
    out = np.frombuffer(margin)
    for plan, value, depth in trees:
        out = out + value.take(plan.nodes(codes, depth))
    return out


def _updated(pending: list, dtypes: list):
    """All rows, margins grown by the pending trees of their model: (model,
    part, block, y, codes, margin)."""
    def run(blocks):
        for model, part, block, y, codes, margin in blocks:
            c = np.frombuffer(codes, dtype=dtypes[model]).reshape(-1, len(y))
            yield model, part, block, y, codes, _margins(margin, pending[model], c).tobytes()
    return run


def _drawn(number: int, seed: int, subsample: float, pending: list, dtypes: list):
    """The sampled rows with their residuals: (model, y, codes, residual)."""
    def run(blocks):
        for model, part, block, y, codes, margin in blocks:
            y = np.frombuffer(y, dtype=np.uint8)
            c = np.frombuffer(codes, dtype=dtypes[model]).reshape(-1, len(y))
            m = _margins(margin, pending[model], c)
            if subsample < 1:
                use = np.flatnonzero(XorShift.of(seed + number + part + 1).skipped(2 * BLOCK * block).doubles(len(y)) < subsample)
                y, c, m = y[use], np.ascontiguousarray(c.take(use, axis=1)), m[use]
            sign = y * 2.0 - 1.0
            with np.errstate(over="ignore"):
                r = sign if number == 0 else 4.0 * sign / (1.0 + np.exp(2.0 * sign * m))
            yield model, y.tobytes(), c.tobytes(), r.tobytes()
    return run


def _summed(plans: list, wanted: list, level: int, columns: list[Columns], weights: list, units: list):
    """(model, sums) of the rows of a task: (rows, rows of class 1, weight x
    residual) x wanted node x (column, bin); the last place has weight x
    residual ** 2 of the node. All are whole numbers, so they do not depend on
    how rows are dealt out."""
    def run(blocks):
        total: dict[int, np.ndarray] = {}
        for model, y, codes, residual in blocks:
            if wanted[model] is None:
                continue
            cols, (slot, slots) = columns[model], wanted[model]
            y, r = np.frombuffer(y, dtype=np.uint8), np.frombuffer(residual)
            c = np.frombuffer(codes, dtype=cols.dtype).reshape(len(cols.sizes), len(y))
            if model not in total:
                total[model] = np.zeros((2, slots, int(cols.starts[-1]) + 1), dtype=np.int64)
            if level:
                mine = slot.take(plans[model].nodes(c, level))
                use = np.flatnonzero(mine >= 0)
                if len(use) < len(y):
                    mine, y, r, c = mine[use], y[use], r[use], c.take(use, axis=1)
            else:
                mine = np.zeros(len(y), dtype=np.int64)
            scaled = r * weights[model].take(y) / units[model]
            stats = (np.array([1.0, 1.0 + PACK]).take(y), np.rint(scaled))
            for j, size in enumerate(cols.sizes):
                cell = mine * size
                cell += c[j]
                a, b = cols.starts[j], cols.starts[j + 1]
                for k, v in enumerate(stats):
                    total[model][k, :, a:b] += np.bincount(cell, weights=v, minlength=slots * size).reshape(slots, size).astype(np.int64)
            total[model][1, :, -1] += np.bincount(mine, weights=np.rint(scaled * r), minlength=slots).astype(np.int64)
        for model, t in total.items():
            yield model, np.stack([t[0] % PACK, t[0] // PACK, t[1]])
    return run


def _merged(sums, tasks: int) -> list:
    """The sums of all tasks at the driver; those of many tasks are added up in
    groups first."""
    if tasks > MERGED:
        groups = math.ceil(math.sqrt(tasks))
        sums = sums.mapPartitionsWithIndex(lambda i, it: (((i % groups, k), v) for k, v in it)) \
            .reduceByKey(np.add, groups).map(lambda kv: (kv[0][1], kv[1]))
    return sums.collect()


def _splits(sums: np.ndarray, columns: Columns) -> tuple[np.ndarray, np.ndarray]:
    """Left and right sums (3 x splits) of a node by feature, one after the
    other. ``sums``: 3 x (column, bin)."""
    left, right = [], []
    for j in range(len(columns.sizes)):
        own = sums[:, columns.starts[j]:columns.starts[j + 1]]
        if j < len(columns.cuts):
            left.append(np.cumsum(own, axis=1)[:, :-1])
            right.append(own.sum(axis=1, keepdims=True) - left[-1])
        else:
            right.append(own[:, 1:-1])
            left.append(own.sum(axis=1, keepdims=True) - right[-1])
    return np.concatenate(left, axis=1), np.concatenate(right, axis=1)


def _weighed(sums: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight, weight x residual, rows) of (rows, rows of class 1, weight x
    residual in units)."""
    return (sums[0] - sums[1]) * model.weights[0] + sums[1] * model.weights[1], sums[2] * model.unit, sums[0]


def _best(sums: np.ndarray, subset: np.ndarray, model: Model, first: np.ndarray):
    """(gain x weight, feature, cut, left, right sums) of the highest gain in
    variance, ties to the first in ``subset``, then the first cut; None without
    a valid split. ``first``: where the splits of a feature begin."""
    left, right = (np.stack(_weighed(x, model)) for x in _splits(sums, model.columns))
    weight, total, _ = left + right
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - total ** 2 / weight
    gain = np.where((left[2] >= 1) & (right[2] >= 1) & (gain >= 0), gain, -np.inf)
    best = None
    for f in subset.tolist():
        a, b = first[f], first[f + 1]
        if a < b:
            i = a + int(gain[a:b].argmax())
            if gain[i] > (best[0] if best else -np.inf):
                best = float(gain[i]), f, int(i - a), left[:, i], right[:, i]
    return best


def reservoir(n: int, k: int, seed: int) -> np.ndarray:
    """``k`` of ``n`` numbers, in the order of the reservoir."""
    out = np.arange(min(k, n))
    rng = XorShift.of(seed)
    for item in range(k, n):
        at = int(rng.next_double() * (item + 1))
        if at < k:
            out[at] = item
    return out


class _Growing:
    """A tree of one model, level by level."""

    def __init__(self, model: Model, p: TreeParams, number: int):
        self.model, self.columns, self.p = model, model.columns, p
        f = len(self.columns.where)
        self.features, self.subset = f, math.ceil(p.colsample * f) if p.colsample < 1 else f
        sizes = [self.columns.sizes[c] - 1 if level is None else 1 for c, level in self.columns.where]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rng = JavaRandom(p.seed + number)
        root = Node(1)
        self.nodes, self.stack, self.splits = {1: root}, [root], {}
        self.sums: dict[int, np.ndarray] = {}            # of nodes of the level above that were split

    def wanted(self, level: int) -> tuple[np.ndarray, int] | None:
        """Places of the nodes whose rows are to be added up; the larger of two
        siblings follows from the other and their parent."""
        if not self.stack:
            return None
        here = {n.heap: n for n in self.stack}
        self.derived = {}
        for h, n in here.items():
            other = self.nodes.get(h ^ 1)
            if level and (h ^ 1) in here and (n.rows, h) > (other.rows, h ^ 1):
                self.derived[h] = h ^ 1
        self.asked = [h for h in here if h not in self.derived]
        slot = np.full(2 << self.p.max_depth, -1, dtype=np.int64)
        slot[self.asked] = np.arange(len(self.asked))
        return slot, len(self.asked)

    def plan(self) -> Plan:
        return _plan(self.columns, self.p.max_depth, self.splits)

    def _pure(self, n: Node, sums: np.ndarray) -> bool:
        return n.rows <= 1 or not n.weight or sums[2, -1] * self.model.unit / n.weight - n.prediction ** 2 < 64 * self.model.unit

    def grown(self, sums: np.ndarray) -> None:
        """Splits the nodes of the level. ``sums``: of the asked nodes."""
        own = {h: sums[:, i] for i, h in enumerate(self.asked)}
        for h, other in self.derived.items():
            own[h] = self.sums[h // 2] - own[other]
        if 1 in own:
            w, t, n = _weighed(own[1][:, :self.columns.sizes[0]].sum(axis=1), self.model)
            self.nodes[1].weight, self.nodes[1].total, self.nodes[1].rows = float(w), float(t), int(n)
        stack, self.stack, self.sums = [n for n in self.stack if n.heap == 1 or not self._pure(n, own[n.heap])], [], own
        chosen = [(n, reservoir(self.features, self.subset, self.rng.next_long()) if self.subset < self.features else np.arange(self.features))
                  for n in stack]
        for n, subset in chosen:
            best = _best(own[n.heap][:, :-1], subset, self.model, self.first)
            if best is None or best[0] <= 0:
                continue
            n.gain, n.split = best[0], (best[1], best[2])
            self.splits[n.heap] = n.split
            for h, (w, t, rows) in ((2 * n.heap, best[3]), (2 * n.heap + 1, best[4])):
                child = self.nodes[h] = Node(h, float(w), float(t), int(rows))
                if h.bit_length() <= self.p.max_depth:
                    self.stack.insert(0, child)

    def tree(self, weight: float) -> Tree:
        order: list[Node] = []

        def walk(h):
            order.append(self.nodes[h])
            if self.nodes[h].split:
                walk(2 * h)
                walk(2 * h + 1)
        walk(1)
        at = {n.heap: i for i, n in enumerate(order)}
        pick = lambda f: np.array([f(n) if n.split else -1 for n in order])
        return Tree(pick(lambda n: n.split[0]), pick(lambda n: n.split[1]), pick(lambda n: at[2 * n.heap]), pick(lambda n: at[2 * n.heap + 1]),
                    np.array([0.0 if n.split else 2.0 * (weight * n.prediction) for n in order]), np.array([float(n.rows) for n in order]),
                    np.array([n.gain for n in order]), np.array([n.heap for n in order]))


def fit_gradient_trees(sets: list[tuple[DataFrame, Preprocessor]], label: str, weight: str | None, p: TreeParams) -> list[GradientTrees]:
    """One model per set of training rows and preparation, all grown in the
    same jobs. The rows are read from written ones, twice each."""
    if p.max_depth > MAX_DEPTH:
        raise ValueError(f"trees deeper than {MAX_DEPTH}")
    with ThreadPoolExecutor(max_workers=len(sets)) as ex:
        models = list(ex.map(lambda i: _prepared(*sets[i], label, weight, i, p.seed), range(len(sets))))
    sc = sets[0][0].sparkSession.sparkContext
    columns, weights, dtypes = [m.columns for m in models], [m.weights for m in models], [m.columns.dtype for m in models]
    units = [m.unit for m in models]
    union = models[0].blocks
    for m in models[1:]:
        union = union.unionByName(m.blocks)
    tasks = max(sc.defaultParallelism, math.ceil(sum(m.rows for m in models) / TASK_ROWS))
    zero = lambda r: (r["model"], r["part"], r["block"], bytes(r["y"]), bytes(r["codes"]), bytes(8 * r["rows"]))
    rows = cut_lineage(union.repartition(tasks)).rdd.map(zero)
    grown = [GradientTrees(m.features, [*m.columns.cuts, *([np.array([0.5])] * (len(m.features) - len(m.columns.cuts)))], 0.0, p) for m in models]
    pending: list = [[] for _ in models]
    held = before = None
    for number in range(p.n_estimators):
        if number % PENDING == 0 and number:
            before, held = held, rows.mapPartitions(_updated(pending, dtypes), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
            rows, pending = held, [[] for _ in models]
            if number % COMMIT == 0:
                rows.checkpoint()
        drawn = rows.mapPartitions(_drawn(number, p.seed, p.subsample, pending, dtypes), preservesPartitioning=True) \
            .persist(StorageLevel.MEMORY_AND_DISK)
        growing = [_Growing(m, p, number) for m in models]
        for level in range(p.max_depth):
            wanted = [g.wanted(level) for g in growing]
            if not any(wanted):
                break
            plans = [g.plan() if w else None for g, w in zip(growing, wanted)]
            sums = [None] * len(models)
            for i, s in _merged(drawn.mapPartitions(_summed(plans, wanted, level, columns, weights, units)), tasks):
                sums[i] = s if sums[i] is None else sums[i] + s
            for i, (g, w) in enumerate(zip(growing, wanted)):
                if w:
                    g.grown(np.zeros((3, w[1], int(columns[i].starts[-1]) + 1), dtype=np.int64) if sums[i] is None else sums[i])
        drawn.unpersist()
        if before is not None:
            before.unpersist()
            before = None
        for i, (g, m) in enumerate(zip(growing, grown)):
            m.trees.append(g.tree(1.0 if number == 0 else p.learning_rate))
            # the margin of the classifier is half of the log-odds
            plan, value, depth = GradientTrees([], [], 0.0, p, [m.trees[-1]]).plans(columns[i])[0]
            pending[i].append((plan, value / 2.0, depth))
    if held is not None:
        held.unpersist()
    return grown
