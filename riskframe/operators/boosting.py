"""ML-5/6, ML-14, SC-6: second-order boosted trees grown best leaf first.

Features are cut at quantiles once; a row then is a few bytes. A tree grows
from histograms of gradient and Hessian sums per (node, feature, bin): tasks
add up their rows, Spark adds up the tasks, and only the sums, whose number
depends on the parameters alone, reach the driver. A pass over the data brings
the histograms of the smaller child of every leaf that can be split; the other
child's are the difference to the parent's. Leaves are split by highest gain
until ``max_leaves``; children of leaves that are not split in the end are
known but unused, so a tree takes about as many passes as it has levels.

Gradients and Hessians are added as whole numbers (2 ** -24), so sums, and
with them the trees, do not depend on how rows are dealt out."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import literal_table
from ..session import cut_lineage
from .evaluation import auc_by
from .ordered import exact_quantiles

UNIT = 1 << 24
#: Trees whose values are added to the stored margin at a time.
COMMIT = 10


@dataclass(frozen=True)
class TreeParams:
    n_estimators: int = 100
    learning_rate: float = 0.1
    max_leaves: int = 31
    max_depth: int = 7
    subsample: float = 0.8
    colsample: float = 0.8
    l1: float = 0.0
    l2: float = 1.0
    min_rows: int = 20
    min_hessian: float = 1e-3
    max_bins: int = 64
    seed: int = 42


# Presets of the two boosted models (fixed values): depth 6 without a leaf cap,
# and depth 7 with 31 leaves; both learning rate 0.1, 100 rounds, subsample and
# colsample 0.8, L1 0, L2 1.
TREE_PRESETS = {
    "boosted": TreeParams(max_leaves=64, max_depth=6, min_rows=1, min_hessian=1.0),
    "boosted_leafwise": TreeParams(),
}


@dataclass
class Tree:
    """Nodes in arrays; ``feature`` is -1 at leaves. A row goes left if its bin
    is at most ``cut``. ``cover``: sampled training rows."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray
    heap: np.ndarray            # 1 at the root, children of i: 2 i and 2 i + 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            left = bins[rows, np.maximum(f, 0)] <= self.cut[at]
            at = np.where(inner, np.where(left, self.left[at], self.right[at]), at)

    def leaves(self) -> int:
        return int((self.feature < 0).sum())


@dataclass
class Booster:
    """Fitted trees: ``features`` (columns), their ``edges``, the starting margin."""
    features: list[str]
    edges: list[np.ndarray]
    start: float
    params: TreeParams
    trees: list[Tree] = field(default_factory=list)
    history: list[tuple[int, float]] = field(default_factory=list)     # (rounds, ROC-AUC on the validation rows)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        """What the trees add to the starting margin."""
        out = np.zeros(len(bins))
        for t in self.trees:
            out += t.value[t.leaf_of(bins)]
        return out

    def records(self) -> list[str]:
        """The model as JSON texts: one for its head, one per tree."""
        head = {"features": self.features, "edges": [e.tolist() for e in self.edges], "start": self.start,
                "params": asdict(self.params), "history": self.history}
        return [json.dumps(head)] + [json.dumps({k: v.tolist() for k, v in vars(t).items()}) for t in self.trees]

    @classmethod
    def from_records(cls, records: list[str]) -> Booster:
        head, *trees = map(json.loads, records)
        return cls(head["features"], [np.array(e, dtype=float) for e in head["edges"]], head["start"], TreeParams(**head["params"]),
                   [Tree(**{k: np.array(v) for k, v in t.items()}) for t in trees], [tuple(h) for h in head["history"]])

    def bins_of(self, columns: list[np.ndarray]) -> np.ndarray:
        """Rows x features; NULL and NaN lie below every edge."""
        out = np.empty((len(columns[0]) if columns else 0, len(columns)), dtype=np.uint8)
        for j, (x, e) in enumerate(zip(columns, self.edges)):
            out[:, j] = np.searchsorted(e, np.where(np.isnan(x), -np.inf, x), side="left")
        return out

    def importance(self, names: list[str] | None = None) -> list[tuple[str, float]]:
        """ML-11: gain of all splits by feature, as shares of the whole gain."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.gain[inner])
        whole = total.sum() or 1.0
        return list(zip(names or self.features, (total / whole).tolist()))


# -- binning ---------------------------------------------------------------------------

def bin_edges(df: DataFrame, cols: list[str], max_bins: int) -> list[np.ndarray]:
    """Per column its distinct quantiles at i / max_bins (i < max_bins), exact;
    columns x bins numbers reach the driver. At most 255 bins."""
    if max_bins > 255:
        raise ValueError("a bin number must fit a byte")
    probs = [i / max_bins for i in range(1, max_bins)]
    out: dict[str, set] = {c: set() for c in cols}
    for r in exact_quantiles(df, cols, probs).select("feature", "quantile").distinct().collect():
        out[r["feature"]].add(r["quantile"])
    return [np.array(sorted(out[c])) for c in cols]


_ROW = [("rid", pa.int64()), ("bins", pa.binary()), ("y", pa.float64()), ("w", pa.float64()), ("margin", pa.float64())]
_ROW_DDL = "rid long, bins binary, y double, w double, margin double"


def _floats(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _packed(bins: np.ndarray) -> pa.Array:
    n, width = bins.shape
    return pa.Array.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(bins).tobytes())]).cast(pa.binary())


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), width)


def _binned(df: DataFrame, model: Booster, key: list[str], label: str, weight: str | None) -> DataFrame:
    schema = pa.schema(_ROW)

    def run(batches):
        for b in batches:
            bins = model.bins_of([_floats(c) for c in b.columns[3:]])
            margin = model.start + model.margin(bins)
            yield pa.RecordBatch.from_arrays([b.column(0), _packed(bins), b.column(1), b.column(2), pa.array(margin)], schema=schema)

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = df.where(F.col(label).isNotNull()).select(F.xxhash64(*key).alias("rid"), F.col(label).cast("double").alias("y"), w.alias("w"),
                                                  *[F.col(c).cast("double") for c in model.features])
    return x.mapInArrow(run, _ROW_DDL)


# -- growing a tree --------------------------------------------------------------------

@dataclass
class Node:
    """A node with its histograms (features x bins x (gradient, Hessian, rows))."""
    heap: int
    sums: np.ndarray
    split: tuple[float, int, int] | None = None        # gain, feature, cut
    children: tuple[Node, Node] | None = None

    @property
    def totals(self) -> np.ndarray:
        return self.sums[0].sum(axis=0) if len(self.sums) else np.zeros(3, dtype=np.int64)


def _shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def score_of(g, h, p: TreeParams):
    return _shrunk(g, p.l1) ** 2 / (h + p.l2)


def best_split(sums: np.ndarray, features: list[int], p: TreeParams) -> tuple[float, int, int] | None:
    """(gain, feature, cut) of the highest gain; ties go to the first feature,
    then the first cut. ``sums``: listed features x bins x 3."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    right = sums.sum(axis=1)[:, None] - left
    gl, hl, gr, hr = (a / UNIT for a in (left[..., 0], left[..., 1], right[..., 0], right[..., 1]))
    whole = sums[0].sum(axis=0) / UNIT
    ok = (left[..., 2] >= p.min_rows) & (right[..., 2] >= p.min_rows) & (hl >= p.min_hessian) & (hr >= p.min_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score_of(gl, hl, p) + score_of(gr, hr, p) - score_of(whole[0], whole[1], p)
    gain = np.where(ok, gain, -np.inf)
    i, cut = np.unravel_index(int(gain.argmax()), gain.shape) if gain.size else (0, 0)
    return (float(gain[i, cut]), features[i], int(cut)) if gain.size and gain[i, cut] > 1e-12 else None


def best_first(root: Node, p: TreeParams) -> tuple[list[Node], list[Node]]:
    """Splits by highest gain (ties: the smaller heap number) as far as the
    children are known: (nodes that were split, leaves)."""
    split, leaves = [], [root]
    while len(leaves) < p.max_leaves:
        able = [n for n in leaves if n.split and n.heap.bit_length() <= p.max_depth]
        node = min(able, key=lambda n: (-n.split[0], n.heap), default=None)
        if node is None or node.children is None:
            return split, leaves
        split.append(node)
        leaves = [n for n in leaves if n is not node] + list(node.children)
    return split, leaves


def _tree_of(root: Node, p: TreeParams, final: bool) -> tuple[Tree, list[Node]]:
    """The tree as far as it is known, and its leaves (by ``heap``). While it
    grows (not ``final``) every node with known children is an inner one."""
    split = {id(n) for n in best_first(root, p)[0]}
    nodes: list[Node] = []

    def walk(n):
        nodes.append(n)
        if n.children and (not final or id(n) in split):
            for c in n.children:
                walk(c)

    walk(root)
    at = {id(n): i for i, n in enumerate(nodes)}
    inner = [bool(n.children) and (not final or id(n) in split) for n in nodes]
    pick = lambda f: np.array([f(n) if i else -1 for n, i in zip(nodes, inner)])
    g, h, rows = (np.array([n.totals[j] for n in nodes], dtype=float) for j in range(3))
    value = -_shrunk(g / UNIT, p.l1) / (h / UNIT + p.l2) * p.learning_rate
    tree = Tree(pick(lambda n: n.split[1]), pick(lambda n: n.split[2]), pick(lambda n: at[id(n.children[0])]),
                pick(lambda n: at[id(n.children[1])]), np.where(inner, 0.0, value), rows,
                np.array([n.split[0] if i else 0.0 for n, i in zip(nodes, inner)]), np.array([n.heap for n in nodes]))
    return tree, nodes


def sampled(rid: np.ndarray, number: int, p: TreeParams) -> np.ndarray:
    """Rows that tree ``number`` is grown from, by a hash of the row's key."""
    if p.subsample >= 1:
        return np.ones(len(rid), dtype=bool)
    h = rid.view(np.uint64) ^ np.uint64((number * 0x9E3779B97F4A7C15 + p.seed) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) < np.uint64(min(int(p.subsample * 2**64), 2**64 - 1))


def histograms(work: DataFrame, model: Booster, committed: int, number: int, tree: Tree | None, wanted: list[int],
               features: list[int]) -> np.ndarray:
    """Sums per (wanted leaf of ``tree``, feature, bin): one pass. ``model``'s
    trees from ``committed`` on are not in the stored margin yet."""
    p, n_bins, width = model.params, model.params.max_bins, len(model.features)
    pending = replace(model, trees=model.trees[committed:])
    slot = np.full(1 if tree is None else len(tree.feature), -1)
    slot[wanted] = np.arange(len(wanted))
    schema = pa.schema([("cell", pa.int64()), ("g", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])

    def run(batches):
        sums = np.zeros((len(wanted) * len(features) * n_bins, 3), dtype=np.int64)
        for b in batches:
            bins = _unpacked(b.column(1), width)
            rid, y, w, margin = (b.column(j).to_numpy() for j in (0, 2, 3, 4))
            prob = 1.0 / (1.0 + np.exp(-(margin + pending.margin(bins))))
            mine = slot[tree.leaf_of(bins)] if tree is not None else np.zeros(len(bins), dtype=np.int64)
            use = np.flatnonzero((mine >= 0) & sampled(rid, number, p))
            g = np.rint((prob - y) * w * UNIT)[use]
            h = np.rint(prob * (1 - prob) * w * UNIT)[use]
            for i, f in enumerate(features):
                cell = (mine[use] * len(features) + i) * n_bins + bins[use, f]
                for j, v in enumerate((g, h, None)):
                    got = np.bincount(cell, weights=v, minlength=len(sums))
                    sums[:, j] += got.astype(np.int64)
        some = np.flatnonzero(sums[:, 2])
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(np.ascontiguousarray(sums[some, j])) for j in range(3)]], schema=schema)

    got = work.mapInArrow(run, "cell long, g long, h long, n long").groupBy("cell") \
        .agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(wanted) * len(features) * n_bins, 3), dtype=np.int64)
    at = got.column("cell").to_numpy()
    for j, c in enumerate(("g", "h", "n")):
        out[at, j] = got.column(c).to_numpy()
    return out.reshape(len(wanted), len(features), n_bins, 3)


def grow_tree(work: DataFrame, model: Booster, committed: int, number: int) -> Tree:
    p = model.params
    rng = np.random.default_rng([p.seed, number])
    width = len(model.features)
    features = sorted(rng.permutation(width)[:max(1, math.ceil(p.colsample * width))].tolist())
    root = Node(1, histograms(work, model, committed, number, None, [0], features)[0])
    root.split = best_split(root.sums, features, p)
    while True:
        split, leaves = best_first(root, p)
        able = [n for n in leaves if n.split and n.children is None and n.heap.bit_length() <= p.max_depth]
        top = min((n for n in leaves if n.split and n.heap.bit_length() <= p.max_depth), key=lambda n: (-n.split[0], n.heap), default=None)
        if len(leaves) >= p.max_leaves or top is None:
            return _tree_of(root, p, final=True)[0]
        for n in able:                                       # children without sums yet, to be found by heap number
            n.children = (Node(2 * n.heap, np.zeros_like(n.sums)), Node(2 * n.heap + 1, np.zeros_like(n.sums)))
        tree, nodes = _tree_of(root, p, final=False)
        at = {n.heap: i for i, n in enumerate(nodes)}
        small = []
        for n in able:
            _, f, cut = n.split
            rows = n.sums[features.index(f), :, 2]
            small.append(2 * n.heap + int(rows[:cut + 1].sum() * 2 > rows.sum()))
        sums = histograms(work, model, committed, number, tree, [at[h] for h in small], features)
        for n, h, s in zip(able, small, sums):
            for c in n.children:
                c.sums = s if c.heap == h else n.sums - s
                c.split = best_split(c.sums, features, p)


# -- boosting --------------------------------------------------------------------------

def _with_margin(work: DataFrame, model: Booster, committed: int) -> DataFrame:
    schema, width = pa.schema(_ROW), len(model.features)
    pending = replace(model, trees=model.trees[committed:])

    def run(batches):
        for b in batches:
            more = pending.margin(_unpacked(b.column(1), width))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(b.column(4).to_numpy() + more)], schema=schema)

    return work.mapInArrow(run, _ROW_DDL)


def staged_margins(work: DataFrame, model: Booster, committed: int) -> DataFrame:
    """(round, y, margin): of every row the margin after each tree from
    ``committed`` on; ``round`` counts trees."""
    schema, width = pa.schema([("round", pa.int32()), ("y", pa.float64()), ("margin", pa.float64())]), len(model.features)
    pending = model.trees[committed:]

    def run(batches):
        for b in batches:
            bins = _unpacked(b.column(1), width)
            margin = b.column(4).to_numpy()
            for i, t in enumerate(pending, committed + 1):
                margin = margin + t.value[t.leaf_of(bins)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), i), pa.int32()), b.column(2), pa.array(margin)], schema=schema)

    return work.mapInArrow(run, "round int, y double, margin double")


def stop_round(history: list[tuple[int, float]], patience: int, last: bool = False) -> int | None:
    """The round after which ``patience`` rounds bring no higher AUC (the first
    such), or None while there may be more to gain; with ``last`` the best round
    even then."""
    best, best_auc = 0, -math.inf
    for r, auc in history:
        if auc > best_auc:
            best, best_auc = r, auc
        elif r - best >= patience:
            return best
    return best or None if last else None


def fit_boosted(train: DataFrame, features: list[str], label: str, key: str | list[str], params: TreeParams | str = "boosted_leafwise",
                weight: str | None = None, validation: DataFrame | None = None, patience: int = 10,
                resume: Booster | None = None) -> Booster:
    """ML-5/6: boosted trees for the 0/1 ``label`` over numeric ``features``.

    ``key``: columns by whose hash rows are sampled. ``validation`` (ML-14): boosting stops once ``patience`` rounds bring no
    higher ROC-AUC on these rows; trees after the best round are dropped.
    ``resume``: goes on from these trees with their bins. NULL features and NaN
    lie below every cut; rows with a NULL label take no part."""
    p = TREE_PRESETS[params] if isinstance(params, str) else params
    key = [key] if isinstance(key, str) else key
    if resume is not None:
        model = replace(resume, params=p, trees=list(resume.trees), history=list(resume.history))
    else:
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        known = train.where(F.col(label).isNotNull())
        ones, zeros = known.agg(F.coalesce(F.sum(F.when(F.col(label) == 1, w)), F.lit(0.0)),
                                F.coalesce(F.sum(F.when(F.col(label) == 0, w)), F.lit(0.0))).first()
        start = math.log(ones / zeros) if ones > 0 and zeros > 0 else 0.0
        model = Booster(list(features), bin_edges(known, features, p.max_bins), start, p)
    work = cut_lineage(_binned(train, model, key, label, weight))
    held = cut_lineage(_binned(validation, model, key, label, None)) if validation is not None else None
    committed = len(model.trees)
    for number in range(committed, p.n_estimators):
        model.trees.append(grow_tree(work, model, committed, number))
        if len(model.trees) - committed < COMMIT and number + 1 < p.n_estimators:
            continue
        if held is not None:
            aucs = auc_by(staged_margins(held, model, committed), "round", "y", "margin")
            model.history += [(r, aucs[r]) for r in sorted(aucs) if aucs[r] is not None]
            best = stop_round(model.history, patience, last=number + 1 == p.n_estimators)
            if best is not None:
                model.trees = model.trees[:best]
                break
            held = cut_lineage(_with_margin(held, model, committed))
        if number + 1 < p.n_estimators:
            work = cut_lineage(_with_margin(work, model, committed))
        committed = len(model.trees)
    return model


def score_boosted(df: DataFrame, model: Booster, out: str = "probability_default") -> DataFrame:
    """SC-1: adds the probability of class 1. NULL and NaN features lie below
    every cut."""
    n = len(df.columns)
    schema_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` double"

    def run(batches):
        for b in batches:
            bins = model.bins_of([_floats(c) for c in b.columns[n:]])
            prob = 1.0 / (1.0 + np.exp(-(model.start + model.margin(bins))))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(prob)], names=[*b.schema.names[:n], out])

    own = [F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(model.features)]
    return df.select("*", *own).mapInArrow(run, schema_ddl)


def trees_table(spark, model: Booster) -> DataFrame:
    """The trees as rows: (tree, node, feature, threshold, left, right, value,
    cover, gain); ``node`` is the heap number, NULLs at leaves as fits."""
    rows = []
    for k, t in enumerate(model.trees):
        for i in range(len(t.feature)):
            f = int(t.feature[i])
            inner = f >= 0
            rows.append((k, int(t.heap[i]), model.features[f] if inner else None, float(model.edges[f][t.cut[i]]) if inner else None,
                         int(t.heap[t.left[i]]) if inner else None, int(t.heap[t.right[i]]) if inner else None,
                         None if inner else float(t.value[i]), int(t.cover[i]), float(t.gain[i]) if inner else None))
    return literal_table(spark, rows, "tree int, node long, feature string, threshold double, left long, right long, "
                                      "value double, cover long, gain double")


# -- contributions ---------------------------------------------------------------------

@dataclass
class Path:
    """A leaf: its value, and per feature on the way the bins (low, high] that
    lead there and the share of training rows that went on."""
    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def paths_of(tree: Tree) -> list[Path]:
    out = []

    def walk(i, conditions):
        if tree.feature[i] < 0:
            f = sorted(conditions)
            out.append(Path(float(tree.value[i]), np.array(f, dtype=np.int64), *(np.array([conditions[x][j] for x in f]) for j in range(3))))
            return
        f, cut = int(tree.feature[i]), int(tree.cut[i])
        low, high, share = conditions.get(f, (-1, 255, 1.0))
        for child, bounds in ((int(tree.left[i]), (low, min(high, cut))), (int(tree.right[i]), (max(low, cut), high))):
            walk(child, {**conditions, f: (*bounds, share * tree.cover[child] / tree.cover[i])})

    walk(0, {})
    return out


def shapley_of_path(share: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Shapley values of the game v(S) = product over S of met, times product
    over the rest of share. ``met``: rows x features, 0 or 1. For each feature
    the others' polynomial prod(share + met t) gives the sums over subsets by
    size: cubic in the path's length."""
    n, m = met.shape
    weight = np.array([math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)])
    out = np.zeros((n, m))
    for f in range(m):
        poly = np.zeros((n, m))
        poly[:, 0] = 1.0
        for i in range(m):
            if i != f:
                moved = poly[:, :-1] * met[:, i:i + 1]
                poly *= share[i]
                poly[:, 1:] += moved
        out[:, f] = (met[:, f] - share[f]) * (poly @ weight)
    return out


#: Features of a path up to which all patterns of met conditions are tabled.
TABLED = 8


class Explainer:
    """Shapley values along tree paths. A row's part of a path depends only on
    which conditions it meets, so each path has a table by that pattern."""

    def __init__(self, model: Booster):
        self.width = len(model.features)
        self.paths = [p for t in model.trees for p in paths_of(t)]
        self.base = model.start + sum(p.value * float(np.prod(p.share)) for p in self.paths)
        self.tables = [self._table(p) if 0 < len(p.features) <= TABLED else None for p in self.paths]

    @staticmethod
    def _table(p: Path) -> np.ndarray:
        m = len(p.features)
        met = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
        return shapley_of_path(p.share, met.astype(float)) * p.value

    def contributions(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), self.width))
        for p, table in zip(self.paths, self.tables):
            if not len(p.features):
                continue
            x = bins[:, p.features]
            met = (x > p.low) & (x <= p.high)
            if table is None:
                kinds, at = np.unique(met, axis=0, return_inverse=True)
                table, code = shapley_of_path(p.share, kinds.astype(float)) * p.value, at.reshape(-1)
            else:
                code = met @ (1 << np.arange(len(p.features)))
            out[:, p.features] += table[code]
        return out


def tree_contributions(df: DataFrame, model: Booster, keep: list[str], names: list[str] | None = None) -> DataFrame:
    """SC-6 for trees: the columns ``keep``, ``margin`` (log-odds),
    ``base_value`` and ``contributions`` (array of feature, value), which add up
    to the margin. Path-dependent Shapley values: a feature left out sends a row
    down both sides by the share of training rows."""
    names = names or model.features
    n = len(keep)
    shared = df.sparkSession.sparkContext.broadcast((model, Explainer(model)))     # as large as the model

    def run(batches):
        model, explainer = shared.value
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                z = b.slice(a, 4096)
                bins = model.bins_of([_floats(c) for c in z.columns[n:]])
                values = explainer.contributions(bins)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), values.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [*z.columns[:n], pa.array(model.start + model.margin(bins)), pa.array(np.full(len(bins), explainer.base)), lists],
                    names=[*z.schema.names[:n], "margin", "base_value", "values"])

    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", margin double, base_value double, values array<double>"
    own = [F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(model.features)]
    x = df.select(*keep, *own).mapInArrow(run, ddl)
    pairs = F.transform("values", lambda v, i: F.struct(F.element_at(F.lit(names), i + 1).alias("feature"), v.alias("value")))
    return x.withColumn("contributions", pairs).drop("values")


def top_contributions(explained: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest contributions of every row by size, ties by name."""
    order = F.array_sort("contributions", lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
                         .when(F.abs(a["value"]) < F.abs(b["value"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1))
    return explained.withColumn("contributions", F.slice(order, 1, n))
