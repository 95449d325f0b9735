"""Nearest neighbours by largest inner product, with adaptive dimension scans.

Index: vectors get one more component, sqrt(M^2 - |x|^2) with M the largest
norm, so that the largest inner product is the smallest distance. A random
rotation follows. Centroids are fitted on at most ``SAMPLE`` vectors (in the
order of a hash); every vector goes to the list of its nearest centroid.

Search: a query probes its nearest lists, as many as hold ``TARGET`` of the
true neighbours within the sample. Its ``k``-th best score among the sampled
rows of those lists is its threshold from the start; the sample gives no row of
the result. A query left with fewer than ``k`` rows scans its lists again
without a threshold. Small lists share a bin, large ones are cut
into blocks, and so are a bin's queries: no list, however full, meets in one
task. Within a block the rotated vectors are scanned in column blocks: after d
of D dimensions a candidate is given up when its partial distance, scaled by
D / d, exceeds the threshold's by the factor (1 + EPSILON / sqrt(d))^2, a
hypothesis test with a failure probability that falls with EPSILON. What is
left is scored exactly, in double precision, on the original vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 20
#: Bound of the sample that the centroids are fitted on.
SAMPLE = 20_000
#: Lists: about the square root of the vectors, within these bounds.
LISTS = (8, 4096)
#: Share of the sample's true neighbours that the probed lists must hold.
TARGET = 0.97
#: Sampled vectors whose neighbours set the number of probes.
CALIBRATE = 256
#: Vectors, and queries, of a bin that meet in one task.
BLOCK = 4096
#: Queries scanned at a time within a task.
CHUNK = 64
COLUMNS = 16
EPSILON = 2.1
SEED = 7


def valid_vectors(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``v`` (array<double>): vectors that are not NULL, not zero,
    without NULL or non-finite components, of the most frequent dimension
    (ties: the smaller), and with an id. Written once; everything reads that."""
    t = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    t = t.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    kept = "array<float>" if "float" in dict(table.dtypes)[vector_col] else "array<double>"      # half the bytes on disk
    t = stored(t.withColumn("v", F.col("v").cast(kept)), "ann-vectors").withColumn("v", F.col("v").cast("array<double>"))
    row = t.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return t.where(F.size("v") == (row["d"] if row else 0))


class Index:
    """What tasks need of the index: rotation, norm bound, centroids (bounded
    by the number of lists) and the bounded sample."""

    def __init__(self, rotation: np.ndarray, bound: float, ids: np.ndarray, sample: np.ndarray):
        self.rotation, self.bound, self.ids, self.sample = rotation, bound, ids, sample
        self.centroids = np.zeros((1, len(rotation)))
        self.lists = np.zeros(len(ids), dtype=np.int64)

    def rotated(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Distances that order queries' candidates by inner product. A query's
        length doesn't matter for the order, so it is brought to the bound."""
        norm2 = (x * x).sum(axis=1)
        if query:
            x, extra = x * (self.bound / np.sqrt(norm2))[:, None], np.zeros(len(x))
        else:
            extra = np.sqrt(np.maximum(self.bound ** 2 - norm2, 0.0))
        return np.hstack([x, extra[:, None]]) @ self.rotation

    def by_distance(self, y: np.ndarray) -> np.ndarray:
        c = self.centroids
        return (c * c).sum(axis=1)[None, :] - 2 * y @ c.T

    def least_scores(self, ids: np.ndarray, x: np.ndarray, probed: np.ndarray, k: int) -> np.ndarray:
        """A score that each query's k-th neighbour within its lists reaches for
        certain: the k-th best among their sampled rows, the query's own row
        left out; -inf with fewer. ``probed``: which lists each query scans."""
        out = np.full(len(x), -np.inf)
        if len(self.ids) <= k:
            return out
        for a in range(0, len(x), 256):
            s = x[a:a + 256] @ self.sample.T
            s[~probed[a:a + 256][:, self.lists] | (ids[a:a + 256, None] == self.ids[None, :])] = -np.inf
            out[a:a + 256] = np.partition(s, -k, axis=1)[:, -k]
        return out - 1e-9 * self.bound * np.sqrt((x * x).sum(axis=1))

    def probes(self, k: int, target: float, queries: int) -> int:
        """Lists to probe so that they hold ``target`` of the true neighbours of
        some sampled vectors within the sample. (The whole table is denser, so
        its neighbours are nearer.)"""
        n = min(queries, len(self.ids))
        q = self.sample[:n]
        s = q @ self.sample.T
        s[np.arange(n), np.arange(n)] = -np.inf
        near = np.argsort(-s, axis=1)[:, :min(k, len(self.ids) - 1)]
        place = self.by_distance(self.rotated(q, query=True)).argsort(axis=1, kind="stable").argsort(axis=1)
        ranks = np.sort(np.take_along_axis(place, self.lists[near], axis=1).ravel())
        return int(ranks[min(int(np.ceil(target * len(ranks))), len(ranks) - 1)]) + 1 if len(ranks) else 1


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)


def fit_index(vectors: DataFrame, *, sample: int = SAMPLE, rounds: int = 12) -> tuple[Index, int] | None:
    """The index of ``valid_vectors`` and their number; None without any."""
    stats = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate(
        "v", F.lit(0.0), lambda s, x: s + x * x)).alias("m2")).first()
    n = stats["n"]
    if not n:
        return None
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "v").toArrow()
    x = _matrix(got.column(1))
    rng = np.random.default_rng(SEED)
    q, r = np.linalg.qr(rng.standard_normal((x.shape[1] + 1, x.shape[1] + 1)))
    index = Index(q * np.sign(np.diag(r)), math.sqrt(stats["m2"]), got.column(0).to_numpy(), x)
    y = np.unique(index.rotated(x).round(12), axis=0)     # copies must not take all centroids
    lists = min(max(round(math.sqrt(n)), LISTS[0]), LISTS[1], len(y))
    c = y[rng.choice(len(y), lists, replace=False)]
    for _ in range(rounds):
        index.centroids = c
        near = np.concatenate([index.by_distance(p).argmin(axis=1) for p in np.array_split(y, max(len(y) // 4096, 1))])
        sums, sizes = np.zeros_like(c), np.bincount(near, minlength=lists)
        np.add.at(sums, near, y)
        c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
    index.centroids = c
    index.lists = np.concatenate([index.by_distance(index.rotated(p)).argmin(axis=1)
                                  for p in np.array_split(x, max(len(x) // 4096, 1))])
    return index, n


_ASSIGNED = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("list", pa.int32())])


#: Vectors compared with all centroids at a time.
SLICE = 512


def assign(vectors: DataFrame, index: Index) -> DataFrame:
    """Adds ``list``: the nearest centroid's number. Every vector is indexed."""
    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE):
                b = whole.slice(a, SLICE)
                near = index.by_distance(index.rotated(_matrix(b.column(1)))).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.list_(pa.float64())),
                                                  pa.array(near, pa.int32())], schema=_ASSIGNED)
    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, list int")


def _probe(shared, sizes: np.ndarray, bins: np.ndarray, probes: int, k: int, kind: pa.DataType, limited: bool = True):
    """Per query and bin: the lists to scan there, and the query's threshold
    (none unless ``limited``). At least ``probes`` lists, and more until they hold 4 (k + 1) vectors."""
    schema = pa.schema([("bin", pa.int32()), ("vec_id", pa.int64()), ("v", pa.list_(kind)),
                        ("least", pa.float64()), ("lists", pa.list_(pa.int32()))])

    def run(batches):
        index: Index = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                b = batch.slice(a, SLICE)
                ids, x = b.column(0).to_numpy(), _matrix(b.column(1))
                order = index.by_distance(index.rotated(x, query=True)).argsort(axis=1, kind="stable")
                need = np.maximum((np.cumsum(sizes[order], axis=1) < 4 * (k + 1)).sum(axis=1) + 1, probes)
                least = np.full(len(x), -np.inf)
                if limited:
                    probed = np.zeros(order.shape, dtype=bool)
                    np.put_along_axis(probed, order, np.arange(order.shape[1])[None, :] < need[:, None], axis=1)
                    least = index.least_scores(ids, x, probed, k)
                at, got, lists = [], [], []
                for i, (o, m) in enumerate(zip(order, need)):
                    mine = np.sort(o[:m][sizes[o[:m]] > 0])
                    for part in np.split(mine, np.flatnonzero(np.diff(bins[mine])) + 1) if len(mine) else []:
                        at.append(i)
                        got.append(int(bins[part[0]]))
                        lists.append(part.tolist())
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got, pa.int32()), b.column(0).take(take), b.column(1).take(take).cast(pa.list_(kind)),
                     pa.array(least[at]), pa.array(lists, pa.list_(pa.int32()))], schema=schema)
    return run


def scan(blocks: list[np.ndarray], queries: np.ndarray, limit: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that survive the tests. ``blocks``: the rotated rows
    in column blocks; ``limit``: each query's squared distance to beat;
    ``allowed``: which pairs are to be scanned at all."""
    dims, at = sum(b.shape[1] for b in blocks), blocks[0].shape[1]
    b, z = blocks[0], queries[:, :at]
    part = np.maximum((z * z).sum(axis=1)[:, None] - 2 * z @ b.T + (b * b).sum(axis=1)[None, :], 0.0)
    slack = lambda d: (1 + EPSILON / math.sqrt(d)) ** 2 * d / dims if d < dims else 1.0
    tiny = 1e-9 * (1 + (queries * queries).sum(axis=1))
    q, r = np.nonzero(allowed & (part <= (limit * slack(at) + tiny)[:, None]))
    d = part[q, r]
    for b in blocks[1:]:
        diff = b[r] - queries[q, at:at + b.shape[1]]
        d = d + np.einsum("ij,ij->i", diff, diff)
        at += b.shape[1]
        keep = d <= limit[q] * slack(at) + tiny[q]
        q, r, d = q[keep], r[keep], d[keep]
    return q, r


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_FOUND_DDL = "query_id long, vec_id long, score double"


def _search_block(shared, k: int, columns: int):
    def run(table: pa.Table) -> pa.Table:
        index: Index = shared.value
        asks = table.column("ask").to_numpy()
        if asks.all() or not asks.any():
            return _FOUND.empty_table()
        ids, v = table.column("vec_id").to_numpy(), _matrix(table.column("v"))
        order = np.argsort(ids[~asks], kind="stable")
        base_ids, base = ids[~asks][order], v[~asks][order]
        lists = [x or [] for x in table.column("lists").to_pylist()]
        base_list = np.array([x[0] for x, a in zip(lists, asks) if not a])[order]
        query_ids, queries = ids[asks], v[asks]
        wanted = [x for x, a in zip(lists, asks) if a]
        least = table.column("least").to_numpy()[asks]
        y, z = index.rotated(base), index.rotated(queries, query=True)
        blocks = [np.ascontiguousarray(y[:, c:c + columns]) for c in range(0, y.shape[1], columns)]
        # the threshold as a squared distance between rotated vectors
        limit = 2 * index.bound ** 2 - 2 * index.bound / np.sqrt((queries * queries).sum(axis=1)) * least
        names, place = np.unique(base_list, return_inverse=True)
        got = ([], [], [])
        for a in range(0, len(queries), CHUNK):
            part = slice(a, a + CHUNK)
            allowed = np.array([np.isin(names, w) for w in wanted[part]])[:, place]
            allowed &= query_ids[part, None] != base_ids[None, :]
            q, r = scan(blocks, z[part], limit[part], allowed)
            score = np.concatenate([(base[r[i:i + 65536]] * queries[part][q[i:i + 65536]]).sum(axis=1)   # one order of sums
                                    for i in range(0, len(r), 65536)] or [np.zeros(0)])
            best = np.lexsort((base_ids[r], -score, q))
            q, r, score = q[best], r[best], score[best]
            first = np.searchsorted(q, q)                   # where the query's rows begin
            keep = (np.arange(len(q)) - first < k) & (score >= least[part][q])
            got[0].append(query_ids[part][q[keep]])
            got[1].append(base_ids[r[keep]])
            got[2].append(score[keep])
        return pa.table([np.concatenate(c) for c in got], schema=_FOUND)
    return run


def binned(sizes: np.ndarray, block: int) -> np.ndarray:
    """Bins of neighbouring lists that hold up to ``block`` vectors together."""
    out, held, at = np.zeros(len(sizes), dtype=np.int64), 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > block:
            at, held = at + 1, 0
        out[i], held = at, held + int(n)
    return out


def nearest(table: DataFrame, *, queries=None, k: int = K, target: float = TARGET, sample: int = SAMPLE,
            block: int = BLOCK, columns: int = COLUMNS, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query (rows where the column
    ``queries`` holds; default: id divisible by 20) its ``k`` nearest rows with
    another id by inner product, ties to the smaller id. ``target`` 1 probes
    every list.

    Vectors that are NULL, zero, or hold NULL or non-finite components take no
    part, nor do rows without an id, nor vectors of another dimension than the
    most frequent one (inner products across dimensions are not defined). An id
    is one item: rows repeated with one id count once (the vector that sorts
    first). An empty table gives an empty result."""
    spark = table.sparkSession
    vectors = valid_vectors(table, id_col=id_col, vector_col=vector_col) \
        .groupBy("vec_id").agg(F.min("v").alias("v"))
    fitted = fit_index(vectors, sample=sample)
    if fitted is None:
        return spark.range(0).select(F.col("id").alias("query_id"), F.col("id").cast("int").alias("rank"),
                                     F.col("id").alias("vec_id"), F.col("id").cast("double").alias("score"))
    index, n = fitted
    shared = spark.sparkContext.broadcast(index)               # bounded: sample, centroids, rotation
    kind = pa.float32() if "float" in dict(table.dtypes)[vector_col] else pa.float64()
    vector = "array<float>" if kind == pa.float32() else "array<double>"
    listed = stored(assign(vectors, index).withColumn("v", F.col("v").cast(vector)), "ann-listed")
    vectors = listed.select("vec_id", F.col("v").cast("array<double>").alias("v"))
    sizes = np.zeros(len(index.centroids), dtype=np.int64)
    for r in listed.groupBy("list").count().collect():         # one row per list: at most LISTS[1]
        sizes[r["list"]] = r["count"]
    probes = len(sizes) if target >= 1 else index.probes(k, target, CALIBRATE)
    bins = binned(sizes, block)
    asked = queries if queries is not None else F.col("vec_id") % 20 == 0
    asks = vectors.where(asked)

    def search(queries: DataFrame, limited: bool) -> DataFrame:
        probed = queries.mapInArrow(_probe(shared, sizes, bins, probes, k, kind, limited),
                                    f"bin int, vec_id long, v {vector}, least double, lists array<int>")
        return _scanned(listed, probed, shared, sizes, bins, k, block, columns)

    found = stored(search(asks, True), "ann-found")
    got = found.groupBy("query_id").count()
    short = asks.join(got, asks.vec_id == got.query_id, "left").where(F.coalesce("count", F.lit(0)) < min(k, n - 1))
    short = stored(short.select("vec_id", "v"), "ann-short")
    if not short.isEmpty():
        found = found.unionByName(search(short, False))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def _scanned(listed: DataFrame, probed: DataFrame, shared, sizes: np.ndarray, bins: np.ndarray, k: int, block: int,
             columns: int) -> DataFrame:
    """Each query's ``k`` best rows of every block of its lists."""
    spark = listed.sparkSession
    loads = {r["bin"]: r["count"] for r in probed.groupBy("bin").count().collect()}
    held = np.bincount(bins, weights=sizes).astype(int)
    # a row per list, at most LISTS[1]: bounded broadcasts
    n_ask = [max(-(-loads.get(b, 0) // block), 1) for b in range(len(held))]
    n_base = [max(-(-int(x) // block), 1) for x in held]
    grid = F.broadcast(spark.createDataFrame([(i, int(b), n_base[b], n_ask[b]) for i, b in enumerate(bins)],
                                             "list int, bin int, n_base int, n_ask int"))
    by_bin = F.broadcast(spark.createDataFrame([(b, n_base[b], n_ask[b]) for b in range(len(held))],
                                               "bin int, n_base int, n_ask int"))
    spot = F.xxhash64("vec_id")
    base = listed.join(grid, "list").select(
        "bin", F.pmod(spot, F.col("n_base")).cast("int").alias("bb"),
        F.explode(F.sequence(F.lit(0), F.col("n_ask") - 1)).alias("qb"), F.lit(False).alias("ask"), "vec_id", "v",
        F.lit(None).cast("double").alias("least"), F.array("list").alias("lists"))
    ask = probed.join(by_bin, "bin").select(
        "bin", F.explode(F.sequence(F.lit(0), F.col("n_base") - 1)).alias("bb"),
        F.pmod(spot, F.col("n_ask")).cast("int").alias("qb"), F.lit(True).alias("ask"), "vec_id", "v", "least", "lists")
    return base.unionByName(ask).groupBy("bin", "bb", "qb").applyInArrow(
        _search_block(shared, k, columns), _FOUND_DDL)
