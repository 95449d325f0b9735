"""ML-13: minority oversampling by interpolation between nearest neighbours.

The k nearest neighbours are exact, found without comparing all pairs:

1. Rows with equal features are one point that carries its k + 1 smallest keys
   (nobody needs more of them), so a group of copies costs one point.
2. A k-d tree, grown from at most about ``SAMPLE`` points picked by hash, deals
   all points out to bins of about ``BIN_ROWS``; a bin's box is exact.
3. Each bin is searched within; the k-th distance found there bounds the
   search: a point visits only bins whose box lies no farther. Boxes are compact,
   so these are a few, and a visit brings back only what lies within the bound.
   A bin that many points visit is searched in blocks of them.

Rounding is monotone and boxes are measured like points, so a box is never
farther than a point in it.

There is no limit on the bins a point visits or on the points of a bin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import hashed_rank

K = 5
SEED = 42
#: Most points that the tree is grown from, and most bins: what the driver holds
#: has a fixed size. Beyond MAX_BINS * BIN_ROWS points bins get fuller.
SAMPLE, MAX_BINS = 1 << 18, 1 << 14
BIN_ROWS = 1024
#: Points that search a bin together in one task.
BLOCK_ROWS = 16_384
#: Numbers in a matrix of distances.
MATRIX = 1 << 21


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, len(x) x len(y), summed feature by feature."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        gap = x[:, j:j + 1] - y[:, j]
        out += gap * gap
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _pieces(n: int, width: int) -> Iterator[slice]:
    step = max(MATRIX // max(width, 1), 1)
    for a in range(0, n, step):
        yield slice(a, a + step)


_POINT = [("id", pa.int64()), ("keys", pa.list_(pa.int64())), ("vec", pa.list_(pa.float64()))]
_POINT_DDL = "id long, keys array<long>, vec array<double>"


def points_of(df: DataFrame, key: str, cols: list[str], keep: int) -> DataFrame:
    """(id, keys, vec): one row per distinct feature vector with its ``keep``
    smallest keys; ``id`` is the first. Spark limits the copies of a vector
    before they are shuffled."""
    rn = F.row_number().over(Window.partitionBy(*cols).orderBy(key))
    few = df.select(F.col(key).cast("long").alias("__key"), *cols).withColumnRenamed("__key", key) \
        .withColumn("__rn", rn).where(F.col("__rn") <= keep)
    g = few.groupBy(*cols).agg(F.array_sort(F.collect_list(key)).alias("keys"))
    return g.select(F.col("keys")[0].alias("id"), "keys", F.array(*cols).alias("vec"))


class Bins:
    """Leaves of a k-d tree; ``low`` and ``high``: corners of their boxes."""

    def __init__(self, some: np.ndarray, total: int):
        self.axis, self.cut, self.child, self.count = [], [], [], 0
        self._grow(some, min(-(-total // BIN_ROWS), MAX_BINS))
        self.axis, self.cut, self.child = np.array(self.axis), np.array(self.cut), np.array(self.child)
        self.low = np.full((self.count, some.shape[1]), np.inf)
        self.high = -self.low

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        at = len(self.axis)
        self.axis.append(-1)
        self.cut.append(0.0)
        self.child.append((self.count, self.count))
        cut = _halves(x) if leaves > 1 else None
        if cut is None:
            self.count += 1
            return at
        left = x[:, cut[0]] < cut[1]
        n = min(max(round(leaves * left.mean()), 1), leaves - 1)
        self.axis[at], self.cut[at] = cut
        self.child[at] = (self._grow(x[left], n), self._grow(x[~left], leaves - n))
        return at

    def of(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while (inner := self.axis[at] >= 0).any():
            right = x[rows, np.maximum(self.axis[at], 0)] >= self.cut[at]
            at = np.where(inner, self.child[at, right.astype(int)], at)
        return self.child[at, 0]


def _halves(x: np.ndarray) -> tuple[int, float] | None:
    """(axis, value): points below the value go left. The widest axis that
    leaves an eighth on either side, else the most even one; None if all points
    are the same."""
    best = None
    for j in np.argsort(-(x.max(axis=0) - x.min(axis=0)), kind="stable") if len(x) else ():
        v = np.sort(x[:, j])
        first = np.searchsorted(v, v[len(v) // 2], side="left")
        after = np.searchsorted(v, v[len(v) // 2], side="right")
        at = min((c for c in (first, after) if 0 < c < len(v)), key=lambda c: abs(c - len(v) / 2), default=None)
        if at is None:
            continue
        even = min(at, len(v) - at)
        if best is None or even > best[0]:
            best = (even, int(j), float(v[at]))
        if even * 8 >= len(v):
            break
    return best[1:] if best else None


def _with_bin(bins: Bins, width: int):
    schema = pa.schema([*_POINT, ("bin", pa.int64())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bins.of(_matrix(b.column(2), width)))], schema=schema)
    return run


def best_of(x: np.ndarray, y: np.ndarray, keys: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, squared distance, key): of every row of ``x`` the k nearest
    keys among the points ``y``; equal distances by key."""
    flat, edge = keys.flatten().to_numpy(zero_copy_only=False), np.asarray(keys.offsets)
    count = np.diff(edge)
    out = []
    for z in _pieces(len(x), len(y)):
        d = squared(x[z], y)
        worst = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        row, at = np.nonzero(d <= worst[:, None])
        times = count[at]
        row, gap = np.repeat(row, times), np.repeat(d[row, at], times)
        within = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        key = flat[np.repeat(edge[at], times) + within]
        order = np.lexsort((key, gap, row))
        row, gap, key = row[order], gap[order], key[order]
        start = np.searchsorted(row, row)                  # rows are sorted
        few = np.arange(len(row)) - start < k
        out.append((row[few] + z.start, gap[few], key[few]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0), np.zeros(0, int))


def _lists(row: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    offsets = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def _search_within(width: int, k: int):
    """Per point of a bin: the best of its own bin and the bound for others
    (squared)."""
    schema = pa.schema([("id", pa.int64()), ("vec", pa.list_(pa.float64())), ("bin", pa.int64()), ("bound", pa.float64()),
                        ("gaps", pa.list_(pa.float64())), ("near", pa.list_(pa.int64()))])

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, keys, vec, at = (t.column(c).combine_chunks() for c in ("id", "keys", "vec", "bin"))
        x = _matrix(vec, width)
        row, gap, key = best_of(x, x, keys, k)
        count = np.bincount(row, minlength=len(x))
        bound = np.full(len(x), np.inf)
        full = count >= k
        bound[full] = gap[np.cumsum(count)[full] - 1]
        gaps, near = _lists(row, len(x), gap, key)
        return pa.Table.from_arrays([ids, vec, at, pa.array(bound), gaps, near], schema=schema)

    return run, "id long, vec array<double>, bin long, bound double, gaps array<double>, near array<long>"


def _asked(bins: Bins, b: pa.RecordBatch):
    """(row, bin) of every other bin that may hold one of the k nearest. Rows
    of one bin come together: its box rules most bins out at once."""
    x, own, bound = _matrix(b.column(1), bins.low.shape[1]), b.column(2).to_numpy(), b.column(3).to_numpy()
    edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
    for a, e in zip(edge, edge[1:]):
        me = own[a]
        apart = np.maximum(np.maximum(bins.low - bins.high[me], bins.low[me] - bins.high), 0.0)
        far = squared(apart, np.zeros((1, apart.shape[1])))[:, 0]
        other = np.flatnonzero((far <= bound[a:e].max()) & (np.arange(len(far)) != me))
        for z in _pieces(e - a, len(other)):
            y, gap = x[a:e][z], np.zeros((len(x[a:e][z]), len(other)))
            for j in range(x.shape[1]):
                off = np.maximum(np.maximum(bins.low[other, j] - y[:, j:j + 1], y[:, j:j + 1] - bins.high[other, j]), 0.0)
                gap += off * off
            row, at = np.nonzero(gap <= bound[a:e][z][:, None])
            yield row + a + z.start, other[at]


def _visit_counts(bins: Bins):
    def run(batches):
        n = np.zeros(bins.count, dtype=np.int64)
        for b in batches:
            for _, at in _asked(bins, b):
                n += np.bincount(at, minlength=bins.count)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bin", "n"])
    return run


def _visits(bins: Bins, blocks: np.ndarray):
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            mixed = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            for row, at in _asked(bins, b):
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mixed[row] % blocks[at]), b.column(0).take(pick), b.column(3).take(pick),
                                                  b.column(1).take(pick)], names=["bin", "block", "id", "bound", "vec"])
    return run, "bin long, block long, id long, bound double, vec array<double>"


def _dealt(blocks: np.ndarray):
    """The points of visited bins, once per block of visitors."""
    def run(batches):
        for b in batches:
            times = blocks[b.column(3).to_numpy()]
            row = np.repeat(np.arange(b.num_rows), times)
            block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(3).take(pick), pa.array(block), b.column(1).take(pick), b.column(2).take(pick)],
                                             names=["bin", "block", "keys", "vec"])
    return run, "bin long, block long, keys array<long>, vec array<double>"


def _search_bin(width: int, k: int):
    schema = pa.schema([("id", pa.int64()), ("gaps", pa.list_(pa.float64())), ("near", pa.list_(pa.int64()))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        x = _matrix(left.column("vec").combine_chunks(), width)
        y = _matrix(right.column("vec").combine_chunks(), width)
        row, gap, key = best_of(x, y, right.column("keys").combine_chunks(), k)
        ok = gap <= left.column("bound").to_numpy()[row]
        row, gap, key = row[ok], gap[ok], key[ok]
        some = np.unique(row)
        gaps, near = _lists(np.searchsorted(some, row), len(some), gap, key)
        return pa.Table.from_arrays([left.column("id").combine_chunks().take(pa.array(some)), gaps, near], schema=schema)

    return run, "id long, gaps array<double>, near array<long>"


def nearest_keys(points: DataFrame, width: int, k: int) -> DataFrame:
    """(id, near): per point the k nearest keys as (gap, key) in order, its own
    among them; ``gap`` is the squared distance. ``points``: from
    :func:`points_of`, written."""
    total = points.count()
    share = min(SAMPLE / max(total, 1), 1.0)
    picked = F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    some = points.where(picked).select("vec").toArrow()
    sample = _matrix(some.column(0).combine_chunks(), width) if some.num_rows else np.zeros((0, width))
    bins = Bins(sample[np.lexsort(sample.T)], total)
    binned = cut_lineage(points.mapInArrow(_with_bin(bins, width), f"{_POINT_DDL}, bin long"))
    ends = [f(F.col("vec")[i]) for f in (F.min, F.max) for i in range(width)]
    for r in binned.groupBy("bin").agg(*ends).collect():                                # at most MAX_BINS rows
        bins.low[r[0]], bins.high[r[0]] = r[1:1 + width], r[1 + width:]
    within, within_ddl = _search_within(width, k)
    own = cut_lineage(binned.groupBy("bin").applyInArrow(within, within_ddl))
    blocks = np.zeros(bins.count, dtype=np.int64)
    for r in own.select("id", "vec", "bin", "bound").mapInArrow(_visit_counts(bins), "bin long, n long") \
            .groupBy("bin").agg(F.sum("n").alias("n")).collect():
        blocks[r["bin"]] = -(-r["n"] // BLOCK_ROWS)
    visits, visits_ddl = _visits(bins, blocks)
    dealt, dealt_ddl = _dealt(blocks)
    search, search_ddl = _search_bin(width, k)
    more = own.select("id", "vec", "bin", "bound").mapInArrow(visits, visits_ddl).groupBy("bin", "block") \
        .cogroup(binned.mapInArrow(dealt, dealt_ddl).groupBy("bin", "block")).applyInArrow(search, search_ddl)
    pairs = own.select("id", "gaps", "near").unionByName(more) \
        .select("id", F.arrays_zip(F.col("gaps").alias("gap"), F.col("near").alias("key")).alias("x"))
    every = F.array_sort(F.flatten(F.collect_list("x")))
    return pairs.groupBy("id").agg(F.slice(every, 1, k).alias("near"))


def _usable(cols: list[str]) -> Column:
    ok = F.lit(True)
    for c in cols:
        x = F.col(c).cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return ok


def nearest_neighbours(df: DataFrame, key: str, cols: list[str], k: int = K) -> DataFrame:
    """(key, rank, neighbour, distance): of every row its k nearest other rows
    (all, if fewer) by Euclidean distance over ``cols``, nearest first, ties to
    the smaller key. ``key``: whole numbers, unique. Rows with a NULL, NaN or
    infinite value take no part; an empty table gives no row."""
    x = df.where(_usable(cols)).select(F.col(key).cast("long").alias("__k"), *[(F.col(c).cast("double") + 0.0).alias(f"__x{i}") for i, c in enumerate(cols)])
    names = [f"__x{i}" for i in range(len(cols))]
    points = cut_lineage(points_of(x, "__k", names, k + 1))
    near = nearest_keys(points, len(cols), k + 1)
    by_vec = points.select("id", *[F.col("vec")[i].alias(f"__y{i}") for i in range(len(cols))]).join(near, "id")
    same = [F.col(f"__x{i}") == F.col(f"__y{i}") for i in range(len(cols))]
    other = F.slice(F.filter("near", lambda n: n["key"] != F.col("__k")), 1, k)
    return x.join(by_vec, same).select("__k", F.posexplode(other).alias("pos", "n")) \
        .select(F.col("__k").alias(key), (F.col("pos") + 1).alias("rank"), F.col("n.key").alias("neighbour"),
                F.sqrt("n.gap").alias("distance"))


def scaled(df: DataFrame, cols: list[str], prefix: str = "__s_") -> DataFrame:
    """Adds every column scaled to [0, 1] by its own range (one aggregate; a
    constant column is 0)."""
    ok = df.where(_usable(cols))
    ends = ok.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("a", F.min), ("b", F.max))]).first()
    out = df
    for i, c in enumerate(cols):
        a, b = ends[f"a_{i}"], ends[f"b_{i}"]
        x = (F.col(c).cast("double") - F.lit(a)) / F.lit(b - a) if a is not None and b > a else F.lit(0.0)
        out = out.withColumn(prefix + c, x)
    return out


def oversample_minority(df: DataFrame, label: str, key: str, numeric: list[str], k: int = K, ratio: float = 1.0,
                        seed: int = SEED) -> DataFrame:
    """The rows of ``df`` and synthetic rows of the smaller class, so that it
    reaches ``ratio`` times the size of the larger one. Adds ``synthetic``,
    ``base`` and ``neighbour`` (keys) and ``share``.

    Neighbours are searched within the minority class on ``numeric``, each
    scaled to [0, 1]. Every usable minority row is the base of as many synthetic
    rows as any other, or one more, in the order of its seeded hash; a synthetic
    row's neighbour (among the k nearest) and ``share`` in [0, 1) come from the
    md5 of base, copy and seed. Its numeric values lie at ``share`` of the way
    from base to neighbour; all other columns, the key set apart (NULL), are the
    base's. A lone minority row is copied. ``df`` should be a written table; a
    NULL label belongs to no class; with one class nothing is added."""
    sizes = {r[label]: r["n"] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) > 2:
        raise ValueError(f"{label!r} has more than two classes")
    plain = df.select("*", F.lit(False).alias("synthetic"), F.lit(None).cast("long").alias("base"),
                      F.lit(None).cast("long").alias("neighbour"), F.lit(None).cast("double").alias("share"))
    for c in numeric:
        plain = plain.withColumn(c, F.col(c).cast("double"))
    small = min(sizes, key=lambda v: (sizes[v], v), default=None)
    extra = round(ratio * max(sizes.values(), default=0)) - sizes.get(small, 0)
    rows = df.where((F.col(label) == F.lit(small)) & _usable(numeric)) if len(sizes) == 2 else None
    usable = rows.count() if rows is not None else 0
    if extra <= 0 or not usable:
        return plain
    near = nearest_neighbours(scaled(rows, numeric), key, [f"__s_{c}" for c in numeric], k)
    near = cut_lineage(near.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))),
                                                         lambda x: x["neighbour"]).alias("__near")))
    times = F.lit(extra // usable) + (F.col("__rn") <= extra % usable).cast("int")
    base = hashed_rank(rows, key, seed, [], out="__rn").withColumn("__times", times).where("__times > 0").drop("__rn", "__rn_n") \
        .join(near.withColumnRenamed(key, "__key"), F.col(key) == F.col("__key"), "left").drop("__key") \
        .withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)))
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("__copy").cast("string"), F.lit(str(seed))))
    number = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("long")
    picked = base.withColumn("neighbour", F.get("__near", F.pmod(number(1), F.size("__near")).cast("int"))) \
        .withColumn("share", number(9) / F.lit(float(1 << 32))).withColumn("base", F.col(key).cast("long"))
    theirs = rows.select(F.col(key).cast("long").alias("__key"), *[F.col(c).cast("double").alias(f"__n_{c}") for c in numeric])
    made = picked.join(theirs, F.col("neighbour") == F.col("__key"), "left")
    for c in numeric:
        x = F.col(c).cast("double")
        made = made.withColumn(c, x + F.coalesce(F.col("share") * (F.col(f"__n_{c}") - x), F.lit(0.0)))
    made = made.withColumn(key, F.lit(None).cast(df.schema[key].dataType)).withColumn("synthetic", F.lit(True))
    return plain.unionByName(made.select(*plain.columns))
