"""FE-1..19: leakage-free feature preparation.

Every transformer is a fit / transform pair: ``fit_*`` computes a small
fitted state from the *training* rows in one distributed aggregation (medians
via exact distributed quantiles, modes via two-level counts, category lists),
``transform`` applies it to any frame as column expressions (exact, and
checkable against SQL), then ``assemble`` feeds Spark ML."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import literal_table
from ..session import cut_lineage
from .ordered import quantile_table
from .profile import long_form_str


def _d(c: str) -> Column:
    return F.col(c).cast("double")


# ------------------------------------------------------------------ FE-1/2/3
def fit_medians(train: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """FE-1 fit: exact median of each column (NULLs ignored)."""
    rows = quantile_table(train, cols, [0.5], ["median"]).collect()
    got = {r["feature"]: r["median"] for r in rows}
    return {c: got.get(c) for c in cols}


def fit_modes(train: DataFrame, cols: list[str], fallback: str = "Unknown") -> dict[str, str]:
    """FE-2 fit: most frequent value, ties -> smallest; all-NULL -> fallback.
    Two distributed aggregations (counts, then the best (count, value) per
    column, combined map-side); no task holds a column's whole value set."""
    cnt = long_form_str(train, cols).where(F.col("value").isNotNull()) \
        .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    best = cnt.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b")) \
        .select("feature", F.col("b.value").alias("mode"))
    got = {r["feature"]: r["mode"] for r in best.collect()}
    return {c: got.get(c, fallback) for c in cols}


def impute(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Apply fitted fill values (FE-1/FE-2/FE-3 transform). A float fill value
    (a median or mean) makes the column double, as ``fillna`` does; other
    values keep the column type."""
    types = dict(df.dtypes)

    def fill(c):
        v = values[c]
        if isinstance(v, float):
            return F.coalesce(_d(c), F.lit(v)).alias(c)
        return F.coalesce(F.col(c), F.lit(v).cast(types[c])).alias(c)
    return df.select(*[fill(c) if c in values and values[c] is not None else F.col(c) for c in df.columns])


def fit_means(train: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """FE-3 (mean strategy) fit."""
    r = train.agg(*[F.avg(_d(c)).alias(c) for c in cols]).first()
    return {c: r[c] for c in cols}


def impute_strategy(train: DataFrame, df: DataFrame, cols: list[str], strategy: str,
                    constant=None) -> DataFrame:
    """FE-3: ``median`` | ``mean`` | ``mode`` | ``constant`` | ``zero`` |
    ``drop_row`` | ``drop_column``; statistics come from ``train`` only."""
    if strategy == "median":
        return impute(df, fit_medians(train, cols))
    if strategy == "mean":
        return impute(df, fit_means(train, cols))
    if strategy == "mode":
        return impute(df, fit_modes(train, cols))
    if strategy == "constant":
        return impute(df, {c: constant for c in cols})
    if strategy == "zero":
        return impute(df, {c: 0 for c in cols})
    if strategy == "drop_row":
        return df.dropna(subset=cols)
    if strategy == "drop_column":
        return df.drop(*cols)
    raise ValueError(f"unknown imputation strategy {strategy!r}")


# ------------------------------------------------------------------ FE-4/5
def fit_moments(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    r = train.agg(*[F.avg(_d(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(_d(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(cols)}


def zscore_filter(df: DataFrame, cols: list[str], z: float = 3.0,
                  moments: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """FE-4: keep rows whose |z| < z in every column (population std). A
    constant column (std 0) has z = 0 rather than dropping every row."""
    mom = moments or fit_moments(df, cols)
    conds = []
    for c in cols:
        m, s = mom[c]
        zc = F.lit(0.0) if not s else F.abs((_d(c) - F.lit(m)) / F.lit(s))
        conds.append(zc < F.lit(z))
    keep = conds[0]
    for cnd in conds[1:]:
        keep = keep & cnd
    return df.where(keep)


def fit_fences(train: DataFrame, cols: list[str], method: str = "iqr", k: float = 1.5,
               z: float = 3.0) -> dict[str, tuple[float, float]]:
    """Fences per column: IQR (q1 - k*iqr, q3 + k*iqr) or mean +- z*std_pop."""
    if method == "iqr":
        q = quantile_table(train, cols, [0.25, 0.75], ["q1", "q3"]).collect()
        return {r["feature"]: (r["q1"] - k * (r["q3"] - r["q1"]), r["q3"] + k * (r["q3"] - r["q1"])) for r in q}
    mom = fit_moments(train, cols)
    return {c: (m - z * s, m + z * s) for c, (m, s) in mom.items()}


def outlier_action(df: DataFrame, fences: dict[str, tuple[float, float]], action: str = "flag") -> DataFrame:
    """FE-5: ``flag`` adds ``<c>_outlier``; ``cap`` clips into the fences;
    ``drop`` removes rows outside any fence (NULL values are kept)."""
    if action == "flag":
        return df.select("*", *[(~_d(c).between(lo, hi)).alias(f"{c}_outlier") for c, (lo, hi) in fences.items()])
    if action == "cap":
        return df.select(*[F.least(F.greatest(_d(c), F.lit(fences[c][0])), F.lit(fences[c][1])).alias(c)
                           if c in fences else F.col(c) for c in df.columns])
    if action == "drop":
        cond = F.lit(True)
        for c, (lo, hi) in fences.items():
            cond = cond & (F.col(c).isNull() | _d(c).between(lo, hi))
        return df.where(cond)
    raise ValueError(f"unknown outlier action {action!r}")


# ------------------------------------------------------------------ FE-6/7
def fit_scaler(train: DataFrame, cols: list[str], method: str = "standard") -> dict[str, tuple[float, float]]:
    """(center, scale) per column. standard: mean / population std; robust:
    median / IQR; minmax: min / (max - min). A zero scale becomes 1."""
    if method == "standard":
        st = fit_moments(train, cols)
    elif method == "robust":
        q = quantile_table(train, cols, [0.25, 0.5, 0.75], ["q1", "med", "q3"]).collect()
        st = {r["feature"]: (r["med"], r["q3"] - r["q1"]) for r in q}
    elif method == "minmax":
        r = train.agg(*[F.min(_d(c)).alias(f"lo{i}") for i, c in enumerate(cols)],
                      *[F.max(_d(c)).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
        st = {c: (r[f"lo{i}"], r[f"hi{i}"] - r[f"lo{i}"]) for i, c in enumerate(cols)}
    else:
        raise ValueError(f"unknown scaler {method!r}")
    return {c: (m, s if s else 1.0) for c, (m, s) in st.items()}


def scale(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    cols = [((_d(c) - F.lit(m)) / F.lit(s)).alias(c + suffix) for c, (m, s) in params.items()]
    if suffix:
        return df.select("*", *cols)
    rep = {c: e for c, e in zip(params, cols)}
    return df.select(*[rep.get(c, F.col(c)) for c in df.columns])


# ------------------------------------------------------------------ FE-8/9
def fit_categories(train: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Sorted distinct non-NULL categories per column (the one-hot vocabulary)."""
    rows = long_form_str(train, cols).where(F.col("value").isNotNull()).distinct().collect()
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[r["feature"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot(df: DataFrame, vocab: dict[str, list[str]], drop_first: bool = True,
            keep_source: bool = False) -> DataFrame:
    """FE-8: ``<col>_<value>`` 0/1 columns in lexicographic order, first level
    dropped; unseen values (and NULL) give all zeros."""
    new = []
    for c, levels in vocab.items():
        for v in (levels[1:] if drop_first else levels):
            new.append(F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{v}"))
    base = df.columns if keep_source else [c for c in df.columns if c not in vocab]
    return df.select(*base, *new)


def fit_level_index(train: DataFrame, cols: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """FE-8 for columns with any number of levels: (feature, value, position),
    positions in lexicographic order from 0, and the number of levels per
    column (all that reaches the driver). Levels are range-partitioned and
    numbered per partition, so no task and no driver holds a column's levels."""
    return index_levels(long_form_str(train, cols).where(F.col("value").isNotNull()).distinct(), cols)


def index_levels(levels: DataFrame, cols: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """:func:`fit_level_index` of known levels: (feature, value), no repeats."""
    placed = cut_lineage(levels.repartitionByRange("feature", "value").withColumn("bucket", F.spark_partition_id()))
    own = Window.partitionBy("feature", "bucket").orderBy("value")
    before = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("feature", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # features x partitions rows
    offsets = counts.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    index = placed.withColumn("own", F.row_number().over(own)).join(F.broadcast(offsets.drop("n")), ["feature", "bucket"]) \
        .select("feature", "value", (F.col("off") + F.col("own") - 1).cast("int").alias("position"))
    sizes = {c: 0 for c in cols} | {r["feature"]: r["n"] for r in counts.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    return index, sizes


def one_hot_sparse(df: DataFrame, index: DataFrame, sizes: dict[str, int], out: str = "one_hot") -> DataFrame:
    """FE-8 as one sparse vector: the blocks of the columns in order, each with
    its first level dropped; unseen values and NULL are all zeros. Levels meet
    the rows in a join, which Spark broadcasts or shuffles by size."""
    cols = [c for c, n in sizes.items() if n > 1]
    for c in cols:
        own = index.where(F.col("feature") == c).select(F.col("value").alias("__v"), F.col("position").alias(f"__p_{c}"))
        df = df.join(own, F.col(f"`{c}`").cast("string") == F.col("__v"), "left").drop("__v")
        # level 0 and what has no position share the last, dropped category
        at = F.col(f"`__p_{c}`")
        df = df.withColumn(f"__i_{c}", F.when(at > 0, at - 1).otherwise(sizes[c] - 1).cast("double")).drop(f"__p_{c}")
    if not cols:
        return df.withColumn(out, array_to_vector(F.array().cast("array<double>")))
    last = literal_table(df.sparkSession, [tuple(float(sizes[c] - 1) for c in cols)],
                         ", ".join(f"i{k} double" for k in range(len(cols))))
    enc = OneHotEncoder(inputCols=[f"i{k}" for k in range(len(cols))], outputCols=[f"__o{k}" for k in range(len(cols))])
    hot = enc.fit(last).transform(df.withColumnsRenamed({f"__i_{c}": f"i{k}" for k, c in enumerate(cols)}))
    parts = [f"__o{k}" for k in range(len(cols))]
    return VectorAssembler(inputCols=parts, outputCol=out).transform(hot).drop(*parts, *[f"i{k}" for k in range(len(cols))])


def fit_top_categories(train: DataFrame, cols: list[str], k: int = 10) -> dict[str, list[str]]:
    """FE-9 fit: the ``k`` most frequent values per column (ties by value), all
    columns from one aggregation. Ranks are taken in salted slices of a column
    first, so a high-cardinality column never lands in one task."""
    cnt = long_form_str(train, cols).where(F.col("value").isNotNull()) \
        .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), F.col("value")]
    part = Window.partitionBy("feature", F.pmod(F.xxhash64("value"), F.lit(256))).orderBy(*order)
    lead = cnt.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k)      # at most 256 k rows a column
    top = lead.withColumn("r", F.row_number().over(Window.partitionBy("feature").orderBy(*order))).where(F.col("r") <= k)
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in sorted(top.collect(), key=lambda r: r["r"]):
        out[r["feature"]].append(r["value"])
    return out


def merge_rare(df: DataFrame, keep: dict[str, list[str]], other: str = "Other") -> DataFrame:
    """FE-9: values outside the kept list become ``other`` (NULL stays NULL)."""
    return df.select(*[F.when(F.col(c).isNull(), None).when(F.col(c).isin(keep[c]), F.col(c))
                       .otherwise(F.lit(other)).alias(c) if c in keep else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ FE-10/11/12
def fit_target_encoding(train: DataFrame, col: str, target: str, smoothing: float = 1.0) -> DataFrame:
    """FE-10 fit: (category, encoding) with encoding = (n * mean + m * prior) /
    (n + m), m = smoothing, prior = global target mean. Returned as a small
    DataFrame (one row per category) so it can be joined without collecting."""
    prior = train.agg(F.avg(_d(target)).alias("prior"))
    g = train.where(F.col(col).isNotNull()).groupBy(col).agg(
        F.count(F.lit(1)).alias("__n"), F.avg(_d(target)).alias("__m"))
    enc = g.crossJoin(F.broadcast(prior)).select(
        col, ((F.col("__n") * F.col("__m") + F.lit(smoothing) * F.col("prior"))
              / (F.col("__n") + F.lit(smoothing))).alias(f"{col}_te"), "prior")
    # the NULL category always has a row: it carries the prior even if no
    # training row has a category
    none = prior.select(F.lit(None).cast(train.schema[col].dataType).alias(col),
                        F.col("prior").alias(f"{col}_te"), "prior")
    return enc.unionByName(none)


def apply_target_encoding(df: DataFrame, enc: DataFrame, col: str) -> DataFrame:
    """FE-10 transform: unseen categories / NULL get the prior. The encoding
    table is joined normally: Catalyst / AQE broadcast it when its measured
    size allows, and shuffle-join it otherwise (high-cardinality keys)."""
    prior = enc.where(F.col(col).isNull()).select("prior")            # one row
    j = df.join(enc.where(F.col(col).isNotNull()).drop("prior"), col, "left").crossJoin(F.broadcast(prior))
    return j.withColumn(f"{col}_te", F.coalesce(F.col(f"{col}_te"), F.col("prior"))).drop("prior")


def frequency_encode(train: DataFrame, df: DataFrame, col: str) -> DataFrame:
    """FE-11: share of training rows holding the category (unseen -> 0)."""
    n = train.agg(F.count(F.lit(1)).alias("__n"))
    f = train.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__c")) \
        .crossJoin(F.broadcast(n)).select(col, (F.col("__c") / F.col("__n")).alias(f"{col}_freq"))
    return df.join(f, col, "left").withColumn(f"{col}_freq", F.coalesce(F.col(f"{col}_freq"), F.lit(0.0)))


# Ordinal order of Education (fixed values).
EDUCATION_ORDER = {"HighSchool": 1, "Bachelor": 2, "Master": 3, "PhD": 4}


def ordinal_encode(df: DataFrame, col: str = "Education", mapping: dict[str, int] | None = None,
                   out: str | None = None) -> DataFrame:
    """FE-12: map lookup; unknown -> NULL."""
    mapping = mapping or EDUCATION_ORDER
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out or f"{col}_ord", m[F.col(col)].cast("int"))


# ------------------------------------------------------------------ FE-13/14/15
# Binning of the feature configuration (fixed values): edges, labels.
BINS = {
    "Age": ([0, 25, 35, 50], ["18-25", "25-35", "35-50", "50+"]),
    "Income": ([0, 35000, 75000], ["low", "mid", "high"]),
    "CreditScore": ([0, 600, 700, 800], ["poor", "fair", "good", "excellent"]),
    "LoanAmount": ([0, 100000, 300000], ["small", "medium", "large"]),
}


def bin_features(df: DataFrame, bins: dict | None = None, suffix: str = "_bin") -> DataFrame:
    """FE-13: left-closed bins [e_i, e_{i+1}); the last bin is unbounded above;
    below the first edge or NULL -> NULL."""
    bins = bins or BINS
    cols = []
    for c, (edges, labels) in bins.items():
        x = _d(c)
        expr = F.when(x.isNull() | (x < F.lit(float(edges[0]))), F.lit(None).cast("string"))
        for e, lab in zip(edges[1:], labels[:-1]):
            expr = expr.when(x < F.lit(float(e)), F.lit(lab))
        cols.append(expr.otherwise(F.lit(labels[-1])).alias(c + suffix))
    return df.select("*", *cols)


def ratio(num: str, den: str, denom_offset: float = 0.0) -> Column:
    """num / (den - offset); NULL when the denominator is <= 0 or NULL."""
    d = _d(den) - F.lit(float(denom_offset))
    return F.when(d > 0, _d(num) / d)


def ratio_features(df: DataFrame, exp_age_offset: float = 18.0, large_loan_ratio: float = 5.0) -> DataFrame:
    """FE-14: debt_to_income = LoanAmount / Income, exp_to_age_ratio =
    YearsExperience / (Age - offset) (documented offset 18; the YAML form is
    offset 0), large_loan_flag = debt_to_income > large_loan_ratio."""
    dti = ratio("LoanAmount", "Income")
    return df.select("*", dti.alias("debt_to_income"),
                     ratio("YearsExperience", "Age", exp_age_offset).alias("exp_to_age_ratio"),
                     (dti > F.lit(large_loan_ratio)).alias("large_loan_flag"))


def finite_or_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """FE-15: NaN, +-inf and NULL -> 0 after transformation."""
    rep = {c: F.when(F.isnan(_d(c)) | (F.abs(_d(c)) == F.lit(float("inf"))) | F.col(c).isNull(), F.lit(0.0))
           .otherwise(_d(c)).alias(c) for c in cols}
    return df.select(*[rep.get(c, F.col(c)) for c in df.columns])


def interactions(df: DataFrame, cols: list[str]) -> DataFrame:
    """FE-19: pairwise products ``<a>_x_<b>``."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return df.select("*", *[(_d(a) * _d(b)).alias(f"{a}_x_{b}") for a, b in pairs])


# ------------------------------------------------------------------ FE-16/17/18
@dataclass
class Preprocessor:
    """FE-18 fitted state: medians / modes / scaler / vocabulary from train."""
    numeric: list[str]
    categorical: list[str]
    medians: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    scaler: dict = field(default_factory=dict)
    vocab: dict = field(default_factory=dict)
    prefix: str = "f__"

    @property
    def feature_names(self) -> list[str]:
        return self.numeric + [f"{c}_{v}" for c in self.categorical for v in self.vocab[c][1:]]

    @property
    def feature_cols(self) -> list[str]:
        """Column names by position: a level may hold any character, dots too."""
        return [f"{self.prefix}{i}" for i in range(len(self.feature_names))]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds one column per feature (``f__<position>``), source columns kept:
        impute -> standard scale -> one-hot (drop first) -> non-finite to 0.
        One projection; no join, no shuffle."""
        out = _scaled_numbers(self)
        for c, v0 in zip(self.categorical, self.filled()):
            for v in self.vocab[c][1:]:
                out.append(F.when(v0 == F.lit(v), 1.0).otherwise(0.0))
        return df.select("*", *[x.alias(n) for x, n in zip(out, self.feature_cols)])

    def numbers(self) -> list[Column]:
        """The numeric features: imputed, scaled, finite."""
        return _scaled_numbers(self)

    def filled(self) -> list[Column]:
        """The categorical columns with the mode for NULL, before one-hot."""
        return [F.coalesce(F.col(c).cast("string"), F.lit(self.modes.get(c))) for c in self.categorical]

    def vector(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Adds the feature vector (FE-16)."""
        return assemble(self.transform(df), self.feature_cols, out)


#: Levels of all categorical columns together up to which each has a column of
#: its own; beyond, levels stay in a table and rows get a sparse vector.
DENSE_LEVELS = 1024


@dataclass
class SparsePreprocessor:
    """The state of :class:`Preprocessor` for any number of levels: they are
    rows (feature, value, position) of the written table ``index``, ``sizes``
    has their number per column. The vector has the same features in the same
    order: the numeric ones, then every level but the first of each column."""
    numeric: list[str]
    categorical: list[str]
    medians: dict
    modes: dict
    scaler: dict
    index: DataFrame
    sizes: dict

    def vector(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Adds the feature vector; levels meet the rows in a join per column,
        which Spark broadcasts or shuffles by size."""
        head = [x.alias(f"f__{i}") for i, x in enumerate(_scaled_numbers(self))]
        fill = [F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c])).alias(f"__fill_{i}") for i, c in enumerate(self.categorical)]
        x = df.select("*", *head, *fill)
        names = {c: f"__fill_{i}" for i, c in enumerate(self.categorical)}
        own = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
        hot = one_hot_sparse(x, self.index.withColumn("feature", own[F.col("feature")]), {names[c]: n for c, n in self.sizes.items()}, "__hot")
        parts = [f"f__{i}" for i in range(len(self.numeric))]
        vec = VectorAssembler(inputCols=[*parts, "__hot"], outputCol=out, handleInvalid="keep").transform(hot)
        return vec.drop(*parts, *names.values(), "__hot")

    def names(self) -> DataFrame:
        """(position, feature) of every feature of the vector."""
        spark = self.index.sparkSession
        first, at = len(self.numeric), {}
        for c in self.categorical:
            at[c] = first - 1                                   # level 0 has no place
            first += max(self.sizes.get(c, 0) - 1, 0)
        own = F.create_map(*[F.lit(v) for kv in at.items() for v in kv])
        levels = self.index.where("position > 0").select((own[F.col("feature")] + F.col("position")).cast("int").alias("position"),
                                                          F.concat_ws("_", "feature", "value").alias("feature"))
        return levels.unionByName(literal_table(spark, list(enumerate(self.numeric)), "position int, feature string"))


def _scaled_numbers(prep) -> list[Column]:
    """Numeric columns imputed, scaled, and 0 where that is not finite."""
    out = []
    for c in prep.numeric:
        m, s = prep.scaler[c]
        med = prep.medians.get(c)
        x = F.coalesce(_d(c), F.lit(med).cast("double")) if med is not None else _d(c)
        z = (x - F.lit(m)) / F.lit(s)
        out.append(F.when(z.isNull() | F.isnan(z) | (F.abs(z) == F.lit(float("inf"))), F.lit(0.0)).otherwise(z))
    return out


def level_counts(train: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, n) of every level, NULL too; one pass, written."""
    return cut_lineage(long_form_str(train, cols).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))


def modes_and_levels(counts: DataFrame, cols: list[str], fallback: str = "Unknown") -> tuple[dict[str, str], dict[str, list[str]]]:
    """Modes and one-hot vocabulary of at most ``DENSE_LEVELS`` levels: the
    vocabulary is that of the filled columns, so the fallback counts where a
    column has NULLs and no value."""
    modes, vocab = {}, {}
    rows = counts.collect()
    for c in cols:
        mine = [(r["value"], r["n"]) for r in rows if r["feature"] == c]
        known = [x for x in mine if x[0] is not None]
        modes[c] = min(known, key=lambda x: (-x[1], x[0]))[0] if known else fallback
        vocab[c] = sorted({v for v, _ in known} | ({modes[c]} if len(mine) > len(known) else set()))
    return modes, vocab


def fit_preprocessor(train: DataFrame, numeric: list[str], categorical: list[str]) -> Preprocessor | SparsePreprocessor:
    """FE-18 fit on the training rows only (never on test), in three passes:
    medians, levels, moments of the filled columns. Only the number of levels
    is known to the driver before it decides whether to look at them."""
    med = fit_medians(train, numeric)
    scaler = fit_scaler(impute(train.select(*numeric), med), numeric, "standard")
    if not categorical:
        return Preprocessor(numeric, categorical, med, {}, scaler, {})
    counts = level_counts(train, categorical)
    if counts.count() <= DENSE_LEVELS:
        modes, vocab = modes_and_levels(counts, categorical)
        return Preprocessor(numeric, categorical, med, modes, scaler, vocab)
    known = counts.where(F.col("value").isNotNull())
    top = known.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b")).collect()       # one row per column
    modes = {c: "Unknown" for c in categorical} | {r["feature"]: r["b"]["value"] for r in top}
    index, sizes = index_levels(known.select("feature", "value"), categorical)
    return SparsePreprocessor(numeric, categorical, med, modes, scaler, cut_lineage(index), sizes)


def assemble(df: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    """FE-16: dense feature vector; the names ride in the column metadata."""
    return VectorAssembler(inputCols=names, outputCol=out, handleInvalid="keep").transform(df)


def select_features(importance: DataFrame, threshold: float = 0.01, top_k: int = 25) -> DataFrame:
    """FE-17 (importance): keep features with importance >= threshold, at most
    top_k by importance (ties by name). ``importance`` is (feature, importance)."""
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))  # one row per feature
    return importance.where(F.col("importance") >= F.lit(threshold)) \
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def drop_correlated(corr_long: DataFrame, cols: list[str], threshold: float = 0.95) -> list[str]:
    """FE-17 (correlation): greedy in column order, drop a column whose |corr|
    with an already kept column exceeds the threshold. Works on the k x k
    correlation table (k^2 rows), not on the data."""
    c = {(r["f1"], r["f2"]): r["corr"] for r in corr_long.collect()}
    kept: list[str] = []
    for col in cols:
        if all(c.get((k, col)) is None or abs(c[(k, col)]) <= threshold for k in kept):
            kept.append(col)
    return kept
