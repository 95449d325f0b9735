"""EDA-1..20: profiling aggregations. Wide single-pass aggregates where
possible (one scan for many columns), long form ``(feature, ...)`` for
output, exact quantiles through ``ordered.exact_quantiles``."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import literal_table
from ..session import cut_lineage
from .ordered import ValueTable, exact_quantiles, long_form, quantile_table, same, value_cumsums, value_table


def _stack(one: DataFrame, cols: list[str], fields: dict[str, str], name: str = "feature") -> DataFrame:
    """Turn a one-row wide aggregate (columns ``<field><i>``) into one row per column."""
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), *[F.col(f"{p}{i}").alias(f) for f, p in fields.items()])
        for i, c in enumerate(cols)])).alias("v")).select("v.*")


def _d(c: str) -> Column:
    return F.col(c).cast("double")


#: Buffer fields of the aggregates of one plan node at most: beyond
#: ``spark.sql.codegen.maxFields`` (100, the key counted) Spark interprets it.
FIELDS = 99


def _by_item(df: DataFrame, items: list[tuple[Column, ...]], fields: int, aggs, names: list[tuple], schema: str) -> DataFrame:
    """One row per item, a tuple of double expressions: its name and
    ``aggs(*item)``, which take ``fields`` buffer fields, from one read. Items
    are dealt to groups whose aggregates stay compiled; a row goes to every
    group. Without rows all aggregates are NULL."""
    per, wide = max(FIELDS // fields, 1), len(items[0])
    none = F.lit(None).cast("double")
    groups = []
    for g in range(0, len(items), per):
        flat = [x for it in items[g:g + per] for x in it]
        flat += [none] * (per * wide - len(flat))
        groups.append(F.struct(F.lit(g).alias("g"), *[x.alias(f"x{i}") for i, x in enumerate(flat)]))
    d = df.select(F.explode(F.array(*groups)).alias("v")).select("v.*")
    cells = [{k: a.alias(f"{k}{i}") for k, a in aggs(*[F.col(f"x{i * wide + j}") for j in range(wide)]).items()} for i in range(per)]
    one = d.groupBy("g").agg(*[a for c in cells for a in c.values()])
    rows = one.select("g", F.posexplode(F.array(*[F.struct(*[F.col(f"{k}{i}").alias(k) for k in c]) for i, c in enumerate(cells)]))) \
        .select((F.col("g") + F.col("pos")).alias("__item"), "col.*")
    own = literal_table(df.sparkSession, [(i, *n) for i, n in enumerate(names)], f"__item int, {schema}")
    return own.join(F.broadcast(rows), "__item", "left").drop("__item")      # a row per item


# ------------------------------------------------------------------ EDA-1/2
def describe(df: DataFrame, cols: list[str], table: ValueTable | None = None) -> DataFrame:
    """EDA-1 + EDA-2: count, mean, std (ddof 1), min, 25/50/75 %, max, and
    bias-corrected skewness / excess kurtosis rounded to 3 places (pandas).
    Spark's skewness/kurtosis are population moments g1/g2; correct with
    G1 = g1*sqrt(n(n-1))/(n-2), G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6)."""
    st = _by_item(df, [(_d(c),) for c in cols], 17, lambda x: {
        "count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x),
        "g1": F.skewness(x), "g2": F.kurtosis(x)}, [(c,) for c in cols], "feature string") \
        .withColumn("count", F.coalesce("count", F.lit(0)))
    q = quantile_table(df, cols, [0.25, 0.5, 0.75], ["q25", "q50", "q75"], table=table).drop("n")
    n = F.col("count").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return st.join(q, "feature", "left").select(
        "feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max",
        F.round(skew, 3).alias("skewness"), F.round(kurt, 3).alias("kurtosis"))


# ------------------------------------------------------------------ EDA-3/6
def histogram(df: DataFrame, cols: list[str], bins: int = 30, by: str | None = None) -> DataFrame:
    """EDA-3 (and EDA-6 with ``by``): equal-width histogram over [min, max]
    per column (per class), last bin closed; empty bins reported as 0.
    bin = least(floor((x - min) * bins / (max - min)), bins - 1)."""
    gb = [by] if by else []
    lf = long_form(df, cols, carry={by: F.col(by)} if by else None).where(F.col("value").isNotNull())
    rng = lf.groupBy("feature", *gb).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # without groups one row per feature, a bounded broadcast; groups may be
    # many, so Spark decides by size
    j = same(lf, rng, ["feature", *gb], hint=not by)
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) * F.lit(float(bins)) / width), F.lit(bins - 1))).cast("int")
    cnt = j.groupBy("feature", *gb, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select("feature", *gb, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return grid.join(cnt, ["feature", *gb, "bin"], "left").select(
        "feature", *gb, "bin", (F.col("lo") + F.col("bin") * w).alias("bin_lo"),
        F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * w).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


# ------------------------------------------------------------------ EDA-4
def kde(df: DataFrame, cols: list[str], grid_points: int = 1000, fine_bins: int = 1024) -> DataFrame:
    """EDA-4: Gaussian KDE density on ``grid_points`` evenly spaced points over
    [min - range/2, max + range/2] with Scott's bandwidth n^(-1/5) * std(ddof 1).
    Binned estimator: rows collapse into ``fine_bins`` equal-width cells
    (weights at cell centres) so the work is cells x grid, not rows x grid."""
    lf = long_form(df, cols).where(F.col("value").isNotNull())
    st = lf.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                                   F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("sd"))
    j = lf.join(F.broadcast(st), "feature")
    width = F.col("hi") - F.col("lo")
    cell = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) * F.lit(float(fine_bins)) / width),
                F.lit(fine_bins - 1))).cast("int")
    cells = j.groupBy("feature", cell.alias("cell")).agg(F.count(F.lit(1)).alias("w"))
    centre = F.col("lo") + (F.col("cell") + F.lit(0.5)) * (F.col("hi") - F.col("lo")) / F.lit(float(fine_bins))
    cells = cells.join(F.broadcast(st), "feature").select(
        "feature", "cell", "w", centre.alias("c"), "n", "sd", "lo", "hi")
    grid = st.select("feature", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("gi"),
                     "lo", "hi")
    xg = (F.col("lo") - (F.col("hi") - F.col("lo")) / 2
          + F.col("gi") * (2 * (F.col("hi") - F.col("lo"))) / F.lit(float(grid_points - 1)))
    grid = grid.select("feature", "gi", xg.alias("x"))
    # cells (<= features x fine_bins) x grid: bounded by the parameters
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    pair = cells.join(F.broadcast(grid), "feature")
    z = F.try_divide(F.col("x") - F.col("c"), h)  # constant column: h = 0 -> NULL density
    dens = pair.groupBy("feature", "gi", "x").agg(
        F.try_divide(F.sum(F.col("w") * F.exp(-0.5 * z * z)), F.first("n") * F.first(h) * F.lit(math.sqrt(2 * math.pi)))
        .alias("density"))
    return dens


def kde_bounded(df: DataFrame, cols: list[str], grid_points: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """EDA-4 with an error bound: ``feature, gi, x, density, error_bound`` on
    the grid and with the bandwidth of :func:`kde`.

    Distinct values collapse into cells of a fraction of the bandwidth, and a
    cell stands at the mean of its values. The first-order error then vanishes,
    and a cell of weight w and variance v is off by at most w v / 2 times the
    largest second derivative of the kernel within it; cells out of the
    kernel's reach add at most its value there. ``error_bound`` sums this up and
    is at most ``tolerance`` times the highest density a kernel of this
    bandwidth can give, because the cell width follows from ``tolerance``. Work
    is grid points x cells within reach, both independent of the rows. NULL and
    NaN are ignored; a constant column has a NULL density."""
    lf = long_form(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    st = lf.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                                   F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("sd"))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    st = cut_lineage(st.withColumn("h", F.when(h > 0, h)))                     # one row per column
    reach = math.sqrt(2 * math.log(4 / tolerance))                             # half the tolerance for what is left out
    cell_share = math.sqrt(tolerance)                                          # cell width in bandwidths: v <= width^2 / 4
    stats = F.broadcast(st)
    at = F.floor((F.col("value") - F.col("lo")) / (F.col("h") * F.lit(cell_share))).cast("long")
    cells = lf.join(stats, "feature").where("h IS NOT NULL").groupBy("feature", at.alias("cell")) \
        .agg(F.count(F.lit(1)).alias("w"), F.avg("value").alias("c"), F.var_pop("value").alias("v"))
    # strips of the kernel's reach: a grid point meets the cells of three of them
    strip = lambda x: F.floor((x - F.col("lo")) / (F.col("h") * F.lit(reach))).cast("long")
    cells = cells.join(stats, "feature").withColumn("strip", strip(F.col("c"))).select("feature", "strip", "w", "c", "v")
    span = F.col("hi") - F.col("lo")
    grid = st.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("gi")) \
        .withColumn("x", F.col("lo") - span / 2 + F.col("gi") * (2 * span) / F.lit(float(grid_points - 1)))
    near = grid.withColumn("own", strip(F.col("x"))) \
        .withColumn("strip", F.explode_outer(F.when(F.col("h").isNotNull(), F.sequence(F.col("own") - 1, F.col("own") + 1))))
    z = (F.col("x") - F.col("c")) / F.col("h")
    # the largest |z^2 - 1| exp(-z^2 / 2) within a cell, from the slope bound 1.4 of that function
    curve = F.abs(z * z - 1) * F.exp(-0.5 * z * z) + F.lit(1.4 * cell_share)
    sums = near.join(cells, ["feature", "strip"], "left").groupBy("feature", "gi").agg(
        F.first("x").alias("x"), F.first("h").alias("h"), F.first("n").alias("n"),
        F.coalesce(F.sum(F.col("w") * F.exp(-0.5 * z * z)), F.lit(0.0)).alias("kernels"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("met"),
        F.coalesce(F.sum(F.col("w") * F.col("v") / (2 * F.col("h") * F.col("h")) * curve), F.lit(0.0)).alias("off"))
    scale = F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi))
    left_out = (F.col("n") - F.col("met")) * F.lit(math.exp(-0.5 * reach * reach))
    return sums.select("feature", "gi", "x", (F.col("kernels") / scale).alias("density"),
                       ((F.col("off") + left_out) / scale).alias("error_bound"))


# ------------------------------------------------------------------ EDA-5/7
def category_counts(df: DataFrame, cols: list[str], top: int | None = None,
                    max_distinct: int | None = None) -> DataFrame:
    """EDA-5: (feature, value, count, rank): every non-NULL value of every
    column; ``rank`` is NULL.

    ``top`` ranks the values (ties by value), keeps that many per column and
    adds the rest of the column as one row with value NULL and rank top + 1.
    ``max_distinct`` lists a column with more values, or with one, as a single
    row with value NULL and rank 0. Counts of a column always add up to its
    non-NULL rows. Ranks are taken in hash slices of a column first, so that no
    task orders all values of a wide column."""
    cnt = long_form_str(df, cols).where(F.col("value").isNotNull()) \
        .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"))
    none, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    if top is None and max_distinct is None:
        return cnt.select("feature", "value", "count", rank.alias("rank"))
    # one row per column
    size = cnt.groupBy("feature").agg(F.count(F.lit(1)).alias("__nd"), F.sum("count").alias("__n"))
    shown = (F.col("__nd") > 1) & (F.col("__nd") <= F.lit(max_distinct)) if max_distinct is not None else F.lit(True)
    c = cnt.join(F.broadcast(size), "feature").where(shown)
    skipped = size.where(~shown).select("feature", none.alias("value"), F.col("__n").alias("count"), F.lit(0).alias("rank"))
    if top is None:
        return c.select("feature", "value", "count", rank.alias("rank")).unionByName(skipped)
    order = [F.col("count").desc(), F.col("value").asc()]
    part = Window.partitionBy("feature", F.pmod(F.xxhash64("value"), F.lit(256))).orderBy(*order)
    lead = c.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)     # at most 256 top rows
    best = lead.withColumn("rank", F.row_number().over(Window.partitionBy("feature").orderBy(*order))) \
        .where(F.col("rank") <= top).select("feature", "value", "count", "rank", "__n", "__nd")
    rest = best.groupBy("feature").agg(F.first("__n").alias("__n"), F.first("__nd").alias("__nd"),
                                       F.sum("count").alias("__k")).where(F.col("__nd") > top) \
        .select("feature", none.alias("value"), (F.col("__n") - F.col("__k")).alias("count"), F.lit(top + 1).alias("rank"))
    return best.select("feature", "value", "count", "rank").unionByName(rest).unionByName(skipped)


def long_form_str(df: DataFrame, cols: list[str], carry: dict[str, Column] | None = None) -> DataFrame:
    carry = carry or {}
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
                                                  F.col(c).cast("string").alias("value")) for c in cols]))
                     .alias("kv"), *[e.alias(k) for k, e in carry.items()]) \
        .select("kv.feature", "kv.value", *carry.keys())


def rate_by_category(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """EDA-7: percentage of target = 1 per category value (row-normalised crosstab)."""
    lf = long_form_str(df, cols, {"y": F.col(target).cast("double")}).where(F.col("value").isNotNull())
    return lf.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"),
                                              (F.avg("y") * 100.0).alias("rate_pct"))


# ------------------------------------------------------------------ EDA-8/9/10
#: Columns up to which every pair is an aggregate of its own in one plan.
WIDE = 24


def _corr(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows where both are known; NULL if one is
    constant there (``corr`` fails then in ANSI mode)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b)))


def correlation_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """EDA-8: Pearson correlation of every pair (pairwise-complete), one scan
    with k(k-1)/2 ``corr`` aggregates in compiled groups (more than ``WIDE`` columns: blocked
    cross-products); long form (f1, f2, corr) incl. diagonal."""
    if len(cols) > WIDE:
        from .wide import correlation_wide
        return correlation_wide(df, cols)
    diagonal = literal_table(df.sparkSession, [(c, c, 1.0) for c in cols], "f1 string, f2 string, corr double")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return diagonal
    one = _by_item(df, [(_d(a), _d(b)) for a, b in pairs], 10, lambda a, b: {"corr": _corr(a, b)}, pairs, "f1 string, f2 string")
    both = F.array(F.struct("f1", "f2", "corr"), F.struct(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "corr"))
    return one.select(F.explode(both).alias("v")).select("v.*").unionByName(diagonal)


def top_correlated_pairs(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    """EDA-9: lower triangle (f1 after f2 in column order), top k by |corr|."""
    pos = {c: i for i, c in enumerate(cols)}
    cl = correlation_long(df, cols)
    order = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(pos[c]))])
    lower = cl.where(order[F.col("f1")] > order[F.col("f2")])
    return lower.withColumn("abs_corr", F.abs("corr")).orderBy(
        F.col("abs_corr").desc(), order[F.col("f1")], order[F.col("f2")]).limit(k)


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """EDA-10: VIF with intercept on complete cases (non-finite -> dropped):
    VIF_i = (R^-1)_ii of the k x k correlation matrix. The matrix (k^2
    numbers) is the only thing that reaches the driver. Singular / empty ->
    NULL."""
    if len(cols) > WIDE:
        from .wide import vif_wide
        return vif_wide(df, cols)
    from ..sources.io import nan_to_null
    clean = nan_to_null(df.select(*[_d(c).alias(c) for c in cols])).dropna()
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    row = clean.agg(F.count(F.lit(1)).alias("n"),
                    *[_corr(F.col(cols[i]), F.col(cols[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    k = len(cols)
    vals: list[float | None] = [None] * k
    if row["n"] and row["n"] > 1:
        r = np.eye(k)
        ok = True
        for i, j in pairs:
            v = row[f"c{i}_{j}"]
            if v is None or not math.isfinite(v):
                ok = False
                break
            r[i, j] = r[j, i] = v
        if ok:
            try:
                inv = np.linalg.inv(r)
                if np.linalg.cond(r) < 1e12:
                    vals = [float(inv[i, i]) for i in range(k)]
            except np.linalg.LinAlgError:
                pass
    spark = df.sparkSession
    return literal_table(spark, [(c, v) for c, v in zip(cols, vals)], "feature string, vif double")


# ------------------------------------------------------------------ EDA-11/12/13
# Decile cut points of the numeric IV binning (fixed values): numpy linspace(0, 1, 11).
DECILES = [float(x) for x in np.linspace(0, 1, 11)]


def decile_edges(df: DataFrame | None, cols: list[str], table: ValueTable | None = None) -> dict[str, list[float]]:
    """Exact decile edges per column, duplicates dropped (qcut duplicates='drop').
    At most 11 numbers per column reach the driver. ``table``: a value table
    with ``cnt`` to read instead."""
    q = exact_quantiles(df, cols, DECILES, table=table)
    edges: dict[str, list[float]] = {c: [] for c in cols}
    for r in q.collect():
        edges[r["feature"]].append((r["q"], r["quantile"]))
    return {c: sorted({v for _, v in sorted(e)}) for c, e in edges.items()}


def decile_bins(df: DataFrame, cols: list[str], edges: dict[str, list[float]]) -> DataFrame:
    """Right-closed bins over the edges, lowest edge included:
    bin = max(#edges < x, 1) - 1; outside [e0, e_last] -> NULL."""
    out = []
    for c in cols:
        e = edges[c]
        x = _d(c)
        if len(e) < 2:
            out.append(F.lit(None).cast("int").alias(c))
            continue
        lt = sum(F.when(x > F.lit(v), 1).otherwise(0) for v in e)
        inside = (x >= F.lit(e[0])) & (x <= F.lit(e[-1]))
        out.append(F.when(inside, F.greatest(lt, F.lit(1)) - 1).cast("int").alias(c))
    return out


def woe_table(df: DataFrame, numeric: list[str], categorical: list[str], target: str,
              zero: float = 1e-10) -> DataFrame:
    """EDA-13: per (feature, bin) event / non-event counts, their shares,
    WOE = ln(pe/pn) and the IV term (pe - pn) * WOE. Numeric features are
    binned on exact deciles; NULL bins are dropped; shares of 0 become 1e-10."""
    parts = []
    ones = [F.count_if(F.col("__y") == 1).alias("events"), F.count_if(F.col("__y") == 0).alias("non_events")]
    if numeric:
        # edges and bins come from one table of distinct values: the rows are read once
        y = F.col(target)
        values = value_table(df, numeric, {"cnt": F.lit(1).cast("long"), "events": F.coalesce((y == 1).cast("long"), F.lit(0)),
                                           "non_events": F.coalesce((y == 0).cast("long"), F.lit(0))})
        edges = decile_edges(None, numeric, values)
        own = F.create_map(*[x for c in numeric for x in (F.lit(c), F.lit(edges[c]).cast("array<double>"))])[F.col("feature")]
        above = F.size(F.filter(own, lambda e: F.col("value") > e))
        bins = values.rows.where(F.size(own) > 1).withColumn("bin", (F.greatest(above, F.lit(1)) - 1).cast("string"))
        parts.append(bins.groupBy("feature", "bin").agg(F.sum("events").alias("events"), F.sum("non_events").alias("non_events"))
                     .where("events + non_events > 0"))
    if categorical:
        lf = long_form_str(df, categorical, {"__y": F.col(target)}).where(F.col("value").isNotNull() & F.col("__y").isNotNull())
        parts.append(lf.groupBy("feature", F.col("value").alias("bin")).agg(*ones))
    cnt = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
    # per-feature totals: one row per feature (bounded), broadcast back -- a
    # high-cardinality categorical never puts all its bins in one task
    tot = cnt.groupBy("feature").agg(F.sum("events").alias("__te"), F.sum("non_events").alias("__tn"))
    cnt = cnt.join(F.broadcast(tot), "feature")
    te, tn = F.col("__te"), F.col("__tn")
    pe = F.when(F.col("events") == 0, F.lit(zero)).otherwise(F.col("events") / te)
    pn = F.when(F.col("non_events") == 0, F.lit(zero)).otherwise(F.col("non_events") / tn)
    t = cnt.select("feature", "bin", "events", "non_events", te.alias("__te"), tn.alias("__tn"),
                   pe.alias("pct_events"), pn.alias("pct_non_events"))
    woe = F.log(F.col("pct_events") / F.col("pct_non_events"))
    return t.select("feature", "bin", "events", "non_events", "pct_events", "pct_non_events",
                    woe.alias("woe"), ((F.col("pct_events") - F.col("pct_non_events")) * woe).alias("iv_term"),
                    ((F.col("__te") == 0) | (F.col("__tn") == 0)).alias("__one_class"))


def information_value(df: DataFrame, numeric: list[str], categorical: list[str], target: str) -> DataFrame:
    """EDA-11/12: IV per feature = sum of the WOE-table terms; 0 when the
    feature's rows hold only one class."""
    t = woe_table(df, numeric, categorical, target)
    return t.groupBy("feature").agg(
        F.when(F.max(F.col("__one_class").cast("int")) == 1, F.lit(0.0)).otherwise(F.sum("iv_term")).alias("iv"))


# ------------------------------------------------------------------ EDA-14
def univariate_auc(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """EDA-14 (and EV-5 with one column): exact ROC-AUC of each column as a
    score for target = 1, ties counted half. Rows with a NULL value are
    skipped; a one-class target gives 0.5.
    AUC = sum_v pos_v * (neg_below_v + neg_v / 2) / (P * N)."""
    y = F.col(target).cast("long")
    cum = value_cumsums(df.where(y.isNotNull()), cols, {"pos": y, "neg": F.lit(1) - y})
    a = cum.groupBy("feature").agg(
        F.sum(F.col("pos") * (F.col("neg_lt") + F.col("neg") / 2.0)).alias("__s"),
        F.first("pos_tot").alias("P"), F.first("neg_tot").alias("N"))
    auc = F.when((F.col("P") == 0) | (F.col("N") == 0), F.lit(0.5)).otherwise(
        F.col("__s") / (F.col("P").cast("double") * F.col("N").cast("double")))
    got = a.select("feature", auc.alias("roc_auc"))
    allf = literal_table(df.sparkSession, [(c,) for c in cols], "feature string")
    return allf.join(got, "feature", "left").select("feature", F.coalesce("roc_auc", F.lit(0.5)).alias("roc_auc"))


# ------------------------------------------------------------------ EDA-15/16/17
def iqr_outliers(df: DataFrame, cols: list[str], k: float = 1.5, table: ValueTable | None = None) -> DataFrame:
    """EDA-15 + EDA-16: quartiles, fences, strict outlier count and boxplot
    whiskers (most extreme values inside the fences)."""
    q = quantile_table(df, cols, [0.25, 0.5, 0.75], ["q1", "median", "q3"], table=table)
    iqr = F.col("q3") - F.col("q1")
    f = q.select("feature", "q1", "median", "q3", (F.col("q1") - k * iqr).alias("lo_fence"),
                 (F.col("q3") + k * iqr).alias("hi_fence"))
    lf = long_form(df, cols).where(F.col("value").isNotNull())
    # fences: one row per feature -> broadcast
    j = lf.join(F.broadcast(f), "feature")
    v = F.col("value")
    agg = j.groupBy("feature").agg(
        F.count_if((v < F.col("lo_fence")) | (v > F.col("hi_fence"))).alias("n_outliers"),
        F.min(F.when(v >= F.col("lo_fence"), v)).alias("whisker_lo"),
        F.max(F.when(v <= F.col("hi_fence"), v)).alias("whisker_hi"))
    return f.join(agg, "feature")


def zscore_outliers(df: DataFrame, cols: list[str], z: float = 3.0, table: ValueTable | None = None) -> DataFrame:
    """EDA-17: NULL -> column median, then |x - mean| / std_pop > z counts."""
    med = {r["feature"]: r["median"] for r in quantile_table(df, cols, [0.5], ["median"], table=table).collect()}
    filled = df.select(*[F.coalesce(_d(c), F.lit(med.get(c))).alias(c) for c in cols])
    st = filled.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)])
    j = filled.crossJoin(F.broadcast(st))  # one-row statistics
    # a constant column has std 0: z is undefined (NULL), never counted
    cnt = j.agg(*[F.count_if(F.abs(F.try_divide(F.col(c) - F.col(f"m{i}"), F.col(f"s{i}"))) > F.lit(z)).alias(f"k{i}")
                  for i, c in enumerate(cols)])
    return _stack(cnt, cols, {"n_extreme": "k"})


# ------------------------------------------------------------------ EDA-18/19/20
def target_distribution(df: DataFrame, target: str, warn_ratio: float = 3.0) -> DataFrame:
    """EDA-18: count and percentage per target value (NULLs left out, as a
    value count does); imbalance ratio max/min count and a warning flag above
    ``warn_ratio``."""
    c = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("count"))
    t = c.agg(F.sum("count").alias("__n"), F.max("count").alias("__mx"), F.min("count").alias("__mn"))
    return c.crossJoin(F.broadcast(t)).select(  # one-row totals
        "target", "count", (F.col("count") * 100.0 / F.col("__n")).alias("pct"),
        (F.col("__mx") / F.col("__mn")).alias("imbalance_ratio")) \
        .withColumn("imbalanced", F.col("imbalance_ratio") > F.lit(warn_ratio))


def target_histogram(df: DataFrame, target: str, bins: int = 40, max_values: int = 20) -> DataFrame:
    """EDA-18 for a numeric target: more than ``max_values`` distinct values
    give an equal-width histogram of ``bins`` bins (bin, bin_lo, bin_hi, count);
    fewer give no rows (``target_distribution`` lists them)."""
    many = df.agg(F.count_distinct(F.col(target)).alias("__nd")).where(F.col("__nd") > max_values)  # one row
    h = histogram(df, [target], bins=bins).drop("feature")
    return h.join(F.broadcast(many), how="cross").drop("__nd")


def numeric_by_class(df: DataFrame, cols: list[str], target: str, max_cols: int | None = None) -> DataFrame:
    """EDA-19: per (feature, class): min, quartiles, max, mean (violin/box
    data) of all columns, or of the first ``max_cols`` that the caller asks
    for. NULL is a class of its own."""
    cols = cols[:max_cols]
    q = quantile_table(df, cols, [0.25, 0.5, 0.75], ["q25", "median", "q75"], by=[target])
    lf = long_form(df, cols, carry={target: F.col(target)}).where(F.col("value").isNotNull())
    a = lf.groupBy("feature", target).agg(F.min("value").alias("min"), F.max("value").alias("max"),
                                          F.avg("value").alias("mean"))
    return same(a, q.drop("n"), ["feature", target])


def top_variance(df: DataFrame, cols: list[str], k: int = 5) -> DataFrame:
    """EDA-20 (first half): the ``k`` columns of largest sample variance."""
    one = df.agg(*[F.var_samp(_d(c)).alias(f"v{i}") for i, c in enumerate(cols)])
    return _stack(one, cols, {"variance": "v"}).orderBy(F.col("variance").desc(), "feature").limit(k)


def pair_grid(df: DataFrame, cols: list[str], bins: int = 10) -> DataFrame:
    """EDA-20 (second half): 2-D equal-width binned counts for every pair of
    ``cols`` (the data behind a pair plot), one scan."""
    ext = df.agg(*[F.min(_d(c)).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(_d(c)).alias(f"hi{i}") for i, c in enumerate(cols)])
    j = df.select(*[_d(c).alias(c) for c in cols]).crossJoin(F.broadcast(ext))

    def b(i, c):
        w = F.col(f"hi{i}") - F.col(f"lo{i}")
        return F.when(w == 0, F.lit(0)).otherwise(
            F.least(F.floor((F.col(c) - F.col(f"lo{i}")) * float(bins) / w), F.lit(bins - 1))).cast("int")
    bc = j.select(*[b(i, c).alias(c) for i, c in enumerate(cols)])
    pairs = [(a, c) for ai, a in enumerate(cols) for c in cols[ai + 1:]]
    lf = bc.select(F.explode(F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(c).alias("f2"),
                                                F.col(a).alias("bin1"), F.col(c).alias("bin2"))
                                       for a, c in pairs])).alias("kv")).select("kv.*")
    return lf.where(F.col("bin1").isNotNull() & F.col("bin2").isNotNull()) \
        .groupBy("f1", "f2", "bin1", "bin2").agg(F.count(F.lit(1)).alias("count"))
