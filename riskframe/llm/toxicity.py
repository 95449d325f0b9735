"""Toxic passages by maximum-scoring segments.

1. *Token log-odds with a Dirichlet prior.* From labelled training documents:
   for each token, and for each beginning of ``PREFIX`` bytes that a token not
   in the table falls back to, the number of toxic and clean documents. The
   prior of a token is its share of all of them, as strong as a ``PRIOR`` share of the
   documents; equal texts count once;
   the log-odds ratio is kept where it passes ``MIN_ODDS`` and its z-score
   ``MIN_Z``. Every other token has a penalty that makes the expected score of
   clean text negative.
2. *Segments.* A linear-time scan (Ruzzo and Tompa) finds all maximal scoring
   segments of a document's token scores.
3. *Extreme-value calibration.* In text of n tokens the best chance segment
   exceeds x with probability 1 - exp(-K n exp(-lambda x)). lambda solves
   E[exp(lambda s)] = 1 over clean tokens; K is its maximum-likelihood value
   over clean documents. A segment is significant by its normalised score
   lambda x - ln(K n). A logistic fit over the best and the summed normalised
   scores turns them into a probability. Both are fitted on labelled documents
   that the log-odds have not seen; the final log-odds then use all of them.

The classifier is fitted on at most ``SAMPLE`` labelled documents, taken in the
order of a hash; every document is scored, over its whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, rows, stored, text_or_empty

#: Bound of the labelled sample that the classifier is fitted on.
SAMPLE = 50_000
#: Bound of the token table (largest |z| first).
MAX_TOKENS = 100_000
#: Strength of the prior: a share of the labelled documents.
PRIOR = 0.04
MIN_Z = 2.5
#: A frequent token may lean significantly, but hardly; only those that lean by
#: this much (natural log) speak for a passage.
MIN_ODDS = 3.0
#: Least penalty of any other token; larger where clean texts would not score
#: negative on average.
DRIFT = 0.05
PREFIX = 4
#: Share of the sample kept from the log-odds for the calibration: 1 in so many.
CALIBRATE_1_IN = 4

_LOWER = bytes(c + 32 if 65 <= c <= 90 else (c if c >= 128 or chr(c).isalnum() else 32) for c in range(256))


def tokens(text: str) -> list[bytes]:
    """A-Z lower-cased; ASCII letters, digits and all other characters beyond
    ASCII form tokens; ASCII punctuation and white space part them."""
    return text.encode("utf-8", "replace").translate(_LOWER).split()


def beginning(token: bytes) -> bytes:
    """What a token falls back to; no token starts with ``^``."""
    return b"^" + token[:PREFIX]


def scored_tokens(toks: list[bytes], table: dict[bytes, float]) -> list[tuple[int, float]]:
    """(position, log-odds) of the tokens that the table knows, whole or by
    their beginning."""
    get = table.get
    return [(i, s) for i, t in enumerate(toks) if (s := get(t) or get(b"^" + t[:PREFIX]))]


def segments(scored: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) of a text
    whose token at each listed position has the listed score and whose other
    tokens score ``-drift``. Linear time in the listed tokens: a segment knows
    the nearest earlier one with a smaller score before it."""
    found: list[list] = []      # start, end, score before it, score up to its end, link
    total, last = 0.0, -1
    for at, s in scored:
        total -= drift * (at - last - 1)
        last = at
        if s <= 0:
            total += s
            continue
        start, before, total = at, total, total + s
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append([start, at, before, total, j])
                break
            start, before, link = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = link
    return [(a, b, up - low) for a, b, low, up, _ in found]


@dataclass
class ToxicityModel:
    table: dict[bytes, float]
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    drift: float = DRIFT

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Tokens of the text; its segments with normalised scores."""
        toks = tokens(text)
        hits = scored_tokens(toks, self.table)
        base = math.log(self.k * max(len(toks), 1))
        return len(toks), [(a, b, self.lam * s - base) for a, b, s in segments(hits, self.drift)]

    def judged(self, text: str) -> tuple[float, int]:
        """Probability of the label toxic, and the number of significant passages."""
        n, found = self.passages(text)
        best = max((s for *_, s in found), default=-math.log(self.k * max(n, 1)))
        good = [s for *_, s in found if s > 0]
        w = self.weights
        x = w[0] + w[1] * best + w[2] * math.log1p(sum(good))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, x)))), len(good)


def held_out(doc_id: Column, fold: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % fold == 0


_CLASSES = ("toxic", "clean", "cal_toxic", "cal_clean")
_COUNTS = pa.schema([("token", pa.binary())] + [(c, pa.int64()) for c in _CLASSES])
_COUNTS_DDL = "token binary, " + ", ".join(f"{c} long" for c in _CLASSES)


def _document_counts(batches: Iterator[pa.RecordBatch]):
    """Documents of each class, and of those the calibration's, that hold a
    token or beginning, added up per task; flushed when the table is large. The
    NULL token counts the documents themselves."""
    counts = [Counter() for _ in _CLASSES]

    def flush():
        for t in set().union(*counts):
            yield (t, *(c[t] for c in counts))
        for c in counts:
            c.clear()

    def out():
        for text, label, cal in rows(batches):
            held = set(tokens(text))
            held |= {beginning(t) for t in held}
            held.add(None)
            counts[1 - label + 2 * cal].update(held)
            if sum(map(len, counts)) > 500_000:
                yield from flush()
        yield from flush()

    return batches_of(out(), _COUNTS)


def fit(docs: DataFrame, labels: DataFrame, *, fold: int = 5, sample: int = SAMPLE,
        max_tokens: int = MAX_TOKENS) -> ToxicityModel:
    """Fit on labelled documents whose crc32(doc_id) mod ``fold`` is not 0.
    Labels or ids that are NULL are left out; without both classes every score
    is the share of toxic labels."""
    spark = docs.sparkSession
    picked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), fold)) \
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers: a bounded broadcast, no shuffle of texts
    picked = picked.select(F.col("doc_id").alias("l_id"), "toxic",
                           (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibrate")), F.lit(CALIBRATE_1_IN)) == 0).alias("cal"))
    chosen = docs.select(F.col("doc_id").alias("d_id"), text_or_empty().alias("text")) \
        .join(F.broadcast(picked), F.col("d_id") == F.col("l_id"))
    # copies would make the words of one text look like words of many; at most
    # `sample` texts (of repeated doc_ids, some more) move
    chosen = chosen.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("len")) \
        .agg(F.min(F.struct("l_id", "text", "toxic", "cal")).alias("x")).select("x.text", "x.toxic", "x.cal")
    counts = stored(chosen.mapInArrow(_document_counts, _COUNTS_DDL).groupBy("token")
                    .agg(*[F.sum(c).alias(c) for c in _CLASSES]), "toxicity-counts")
    model = ToxicityModel(_log_odds(counts.select("token", "toxic", "clean"), max_tokens))
    _calibrate(model, chosen.where("cal").select("text", "toxic"), spark)
    model.table = _log_odds(counts.select("token", (F.col("toxic") + F.col("cal_toxic")).alias("toxic"),
                                          (F.col("clean") + F.col("cal_clean")).alias("clean")), max_tokens)
    return model


def _log_odds(counts: DataFrame, max_tokens: int) -> dict[bytes, float]:
    """The bounded token table, computed by Spark: informative Dirichlet prior
    over documents that hold the token."""
    of = counts.where("token IS NULL").select(F.col("toxic").alias("n1"), F.col("clean").alias("n0"))
    # one row
    t = counts.where("token IS NOT NULL AND toxic + clean >= 3").crossJoin(F.broadcast(of)) \
        .where("n1 > 0 AND n0 > 0")
    strength = F.lit(PRIOR) * (F.col("n1") + F.col("n0"))
    prior = F.lit(PRIOR) * (F.col("toxic") + F.col("clean"))
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    ra, rb = F.col("n1") + strength - a, F.col("n0") + strength - b
    t = t.withColumn("odds", F.log(a / F.greatest(ra, F.lit(0.5))) - F.log(b / F.greatest(rb, F.lit(0.5)))) \
        .withColumn("z", F.col("odds") / F.sqrt(1 / a + 1 / b))
    best = t.where((F.abs("z") >= MIN_Z) & (F.abs("odds") >= MIN_ODDS)).orderBy(F.abs("z").desc(), "token").limit(max_tokens).select("token", "odds")
    got = best.toArrow()
    return {bytes(k): v for k, v in zip(got.column(0).to_pylist(), got.column(1).to_pylist())}


def _calibrate(model: ToxicityModel, labelled: DataFrame, spark) -> None:
    table = model.table

    def hits(batches):
        """Per document: label, tokens, positions and scores of known tokens."""
        def one(text, label):
            toks = tokens(text)
            found = scored_tokens(toks, table)
            return label, len(toks), [i for i, _ in found], [s for _, s in found]
        return batches_of((one(t, y) for t, y in rows(batches)), _HITS, size=512)

    # at most SAMPLE / CALIBRATE_1_IN documents' known tokens
    got = labelled.mapInArrow(hits, "label int, n long, at array<int>, scores array<double>").toArrow().to_pylist()
    clean = [r for r in got if r["label"] == 0]
    if not clean or len(clean) == len(got):
        share = min(max((len(got) - len(clean) + 0.5) / (len(got) + 1.0), 1e-3), 1 - 1e-3)
        model.weights = (math.log(share / (1 - share)), 0.0, 0.0)
        return
    scores = np.array([s for r in clean for s in r["scores"]] or [0.0])
    others = max(sum(r["n"] for r in clean) - len(scores), 1)
    # twice what the known tokens add on average
    model.drift = max(DRIFT, 2 * float(scores.sum()) / others)
    model.lam = _lambda(scores, others, model.drift)
    for r in got:
        r["found"] = [s for *_, s in segments(list(zip(r["at"], r["scores"])), model.drift)]
    top = np.array([max(r["found"], default=0.0) for r in clean])
    n = np.array([max(r["n"], 1) for r in clean], dtype=float)
    model.k = min(max(len(clean) / max(float((n * np.exp(-model.lam * top)).sum()), 1e-9), 1e-6), 1e6)
    rowsx, y = [], []
    for r in got:
        base = math.log(model.k * max(r["n"], 1))
        norm = [model.lam * s - base for s in r["found"]]
        rowsx.append((1.0, max(norm, default=-base), math.log1p(sum(s for s in norm if s > 0))))
        y.append(r["label"])
    model.weights = _logistic(np.array(rowsx), np.array(y, dtype=float))


_HITS = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("at", pa.list_(pa.int32())),
                   ("scores", pa.list_(pa.float64()))])


def _lambda(hits: np.ndarray, others: int, drift: float) -> float:
    """The positive root of E[exp(lambda s)] = 1 (by bisection); 1 if there is none."""
    n = len(hits) + others
    mean = (hits.sum() - drift * others) / n
    if mean >= 0 or hits.max() <= 0:
        return 1.0
    f = lambda x: (np.exp(x * hits).sum() + others * math.exp(-x * drift)) / n - 1
    lo, hi = 1e-6, 1e-3
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression over the bounded sample: Newton steps, halved
    until the objective falls (labels may be separable)."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z = x / scale

    def cost(w):
        m = z @ w
        return float(np.logaddexp(0, m).sum() - (y * m).sum() + ridge / 2 * (w @ w))

    w = np.zeros(x.shape[1])
    now = cost(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        g = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), g)
        t = 1.0
        while t > 1e-6 and cost(w - t * step) > now:
            t /= 2
        w = w - t * step
        before, now = now, cost(w)
        if before - now < 1e-9:
            break
    return tuple(float(v) for v in w / scale)


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", pa.int32())])


def score(docs: DataFrame, model: ToxicityModel, *, fold: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted, passages`` (significant ones) per
    row; NULL and empty texts get the score of a text without tokens. Repeated
    rows each give a row; an empty table gives none. Narrow: no shuffle."""
    def run(batches):
        return batches_of(((i, *model.judged(t)) for i, t in rows(batches)), _SCORES)

    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
        .mapInArrow(run, "doc_id long, score double, passages int")
    return s.select("doc_id", F.coalesce(held_out(F.col("doc_id"), fold), F.lit(False)).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "passages")


def passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Every significant passage: ``doc_id, first_token, last_token, score``."""
    def run(batches):
        return batches_of(((i, a, b, s) for i, t in rows(batches) for a, b, s in model.passages(t)[1] if s > 0), _SPANS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
        .mapInArrow(run, "doc_id long, first_token int, last_token int, score double")


_SPANS = pa.schema([("doc_id", pa.int64()), ("first_token", pa.int32()), ("last_token", pa.int32()),
                    ("score", pa.float64())])


def clean_documents(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, that score under ``threshold``."""
    @F.pandas_udf("double")
    def probability(text: pd.Series) -> pd.Series:
        return pd.Series([model.judged(t)[0] for t in text], dtype="float64")

    return docs.where(probability(text_or_empty()) < threshold)
