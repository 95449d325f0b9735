"""Mixing sources to target weights by Sainte-Lague apportionment, with
DataFrame functions only.

Targets. Sources in code-point order (NULL last) get the weights in turn and
share ``factor`` times all words. A target stops at ``repeats`` times its
source's words; the excess is shared again by weight until none is above.

Blocks. The documents of a source are dealt to shards by a seeded hash, so
that no task holds a source. A shard's documents, in seeded order, form one
tape of words that is cut into blocks of ``block`` words. Sources get blocks by
the highest quotients target / (2k + 1), and a source's blocks go to its
shards by the highest quotients words / (2k + 1): an integer quota per shard,
at most ``repeats`` times the shard's blocks. Seats are not listed: divisors
just above and below the last one bound every quota, and only the quotients
between them, a few per row, are ranked.

Selection. A shard takes its blocks at even steps along the tape from a seeded
first one, so the words taken from a document follow from where it stands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, stored, text_or_empty

#: Fixed values of the query: weights in turn, share of all words, repeats of a source.
WEIGHTS = (3, 1, 2)
FACTOR = 1.5
REPEATS = 2
BLOCK = 64
SHARD_WORDS = 1 << 16
SEED = 13


def words(text: Column) -> Column:
    """Number of runs without white space."""
    return F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]++")).cast("long")


def ranked(df: DataFrame, group: list[str], order: list[Column], out: str, name: str) -> DataFrame:
    """``df`` with ``out``: row number from 1 within ``group`` (NULL is a group),
    by ``order``. Rows are sorted by range, so no task holds a group; only one
    row per partition meets in one task."""
    placed = stored(df.orderBy(*[F.col(g).asc_nulls_last() for g in group], *order)
                    .withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    per = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)      # one row per partition
    offset = per.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    at = placed.withColumn("__p", part).join(offset, "__p") \
        .withColumn("__n", F.col("__o") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__o", "__at")
    first = at.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]).agg(F.min("__n").alias("__f"))
    match = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    j = at.join(first, match, "inner") if group else at.crossJoin(first)           # one row without groups
    return j.withColumn(out, F.col("__n") - F.col("__f") + 1).drop("__n", "__f", *[f"__g{i}" for i in range(len(group))])


def apportion(df: DataFrame, group: list[str], key: list[str], name: str) -> DataFrame:
    """Sainte-Lague: (*group, *key, quota). ``df`` has one row per (group, key)
    with ``votes`` (0 or more), ``cap`` (most seats) and the group's ``seats``.
    Equal quotients go by ``key``, NULL last."""
    tot = df.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(
        F.sum("votes").cast("double").alias("all"), F.count_if(F.col("votes") > 0).alias("some"))
    match = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    d = (df.join(tot, match) if group else df.crossJoin(tot)).drop(*[f"__{g}" for g in group])

    def held(seats: Column) -> Column:
        """Seats of a row with the divisor that gives its group about ``seats``."""
        x = F.floor(F.try_divide(F.col("votes") * F.greatest(seats, F.lit(0.0)), F.col("all")) + 0.5)
        return F.least(F.col("cap"), F.coalesce(x, F.lit(0))).cast("long")

    d = d.withColumn("low", held(F.col("seats") - F.col("some") / 2.0 - 1))
    margin = 1
    while True:                                   # caps may ask for a smaller divisor
        high = F.when(F.col("votes") > 0, F.least("cap", held(F.col("seats") + margin * F.col("some")) + 1)).otherwise(0)
        both = d.withColumn("high", high.cast("long"))
        sums = both.groupBy(*group).agg(F.sum("high").alias("high"), F.max("seats").alias("seats"),
                                        F.sum(F.when(F.col("votes") > 0, F.col("cap"))).alias("most"))
        if sums.where("high < seats AND high < most").isEmpty():
            break
        margin *= 2
    both = stored(both, f"{name}-bounds")
    open_seats = both.where("high > low").select(*group, *key, "votes", F.explode(F.sequence("low", F.col("high") - 1)).alias("__k"))
    best = [(F.col("votes") / (2 * F.col("__k") + 1)).desc(), *[F.col(c).asc_nulls_last() for c in key], F.col("__k")]
    by_rank = ranked(open_seats, group, best, "rank", f"{name}-quotients")
    left = both.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg((F.max("seats") - F.sum("low")).alias("left"))
    won = (by_rank.join(left, match) if group else by_rank.crossJoin(left)).where("rank <= left") \
        .groupBy(*[F.col(c).alias(f"__{c}") for c in [*group, *key]]).agg(F.count(F.lit(1)).alias("won"))
    j = both.join(won, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*group, *key]], "left")
    return j.select(*group, *key, (F.col("low") + F.coalesce("won", F.lit(0))).alias("quota"))


def targets(sources: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR,
            repeats: int = REPEATS) -> tuple[DataFrame, float]:
    """(source, words) to (source, words, target) and the sum of all targets.
    Every round is one aggregate of whole numbers over the sources, so reruns
    agree to the last bit."""
    place = ranked(sources, [], [F.col("source").asc_nulls_last()], "place", "mix-sources")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    s = stored(place.withColumn("weight", turn.cast("long")).drop("place"), "mix-weights")
    whole = s.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("w")).first()["w"]
    level, stopped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > repeats * F.col("words")
        r = s.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, F.col("words"))), F.lit(0)).alias("w"),
                  F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("free")).first()
        if r["n"] == stopped or not r["free"]:
            break
        stopped, level = r["n"], (factor * whole - repeats * r["w"]) / r["free"]
    target = F.least(repeats * F.col("words").cast("double"), F.col("weight") * F.lit(level))
    return s.select("source", "words", target.alias("target")), min(factor, repeats) * whole


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, repeats: int = REPEATS,
        block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """One row per input row: ``doc_id, source, size`` (words), ``source_size``,
    ``target`` (words its source should give), ``taken`` (words the mix takes
    from the document, repeats counted; at most ``repeats`` times its size),
    ``shard``, ``start`` and ``stop`` (its words on the shard's tape), ``blocks``
    and ``quota`` (the shard's): block b, of ``block`` words from b * block on,
    is taken floor(((b + 1) * quota + first) / blocks) - floor((b * quota +
    first) / blocks) times, with the seeded ``first``.

    NULL text has size 0; documents without words take part with 0 taken. A
    NULL source is a source, the last one; a NULL doc_id counts as an empty id.
    Repeated rows each give a row and stand one after another on the tape. An
    empty table, or one without words, gives targets of 0. Other columns are
    not read. The result depends on ``seed``, doc_id, source and size only."""
    sized = stored(docs.select("doc_id", "source", words(text_or_empty()).alias("size")), "mix-sizes")
    rows = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("words"))
    goal, all_words = targets(per_source, weights=weights, factor=factor, repeats=repeats)
    goal = stored(goal, "mix-targets").withColumn("shards", F.ceil(F.col("words") / shard_words).cast("long"))

    def to_source(df):
        g = goal.select(F.col("source").alias("__s"), "words", "target", "shards")
        return df.join(g, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")

    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    number = lambda x: F.conv(F.substring(x, 1, 8), 16, 10).cast("long")
    placed = to_source(rows).withColumn("h", h) \
        .withColumn("shard", F.when(F.col("size") > 0, F.pmod(number(F.reverse("h")), F.greatest("shards", F.lit(1)))))
    tape = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    some = placed.where("size > 0").withColumn("at", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(tape), F.lit(0)))
    some = stored(some, "mix-tapes")

    cells = stored(some.groupBy("source", "shard").agg(F.max(F.col("at") + F.col("size") * F.col("copies")).alias("votes"))
                   .withColumn("blocks", F.ceil(F.col("votes") / block).cast("long")), "mix-cells")
    per = cells.groupBy("source").agg(F.sum("blocks").alias("blocks"))
    houses = to_source(per).select("source", F.col("target").alias("votes"), (repeats * F.col("blocks")).alias("cap"),
                                   F.lit(round(all_words / block)).cast("long").alias("seats"))
    seats = apportion(houses, [], ["source"], "mix-sources").select(F.col("source").alias("__s"), F.col("quota").alias("seats"))
    by_cell = cells.join(seats, F.col("source").eqNullSafe(F.col("__s"))) \
        .select("source", "shard", "votes", (repeats * F.col("blocks")).alias("cap"), "seats")
    quotas = apportion(by_cell, ["source"], ["shard"], "mix-shards")
    first = number(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("shard").cast("string")))) % F.col("blocks")
    plan = quotas.select(F.col("source").alias("__s"), F.col("shard").alias("__h"), "quota") \
        .join(cells, F.col("source").eqNullSafe(F.col("__s")) & (F.col("shard") == F.col("__h"))) \
        .select("__s", "__h", "quota", "blocks", first.alias("first"))

    def up_to(x: str) -> str:
        """Words taken from the first ``x`` words of the tape."""
        picked = lambda b: f"(({b}) * quota + first) div blocks"
        b = f"{x} div {block}"
        return f"{block} * ({picked(b)}) + ({x} % {block}) * ({picked(f'{b} + 1')} - {picked(b)})"

    out = some.join(plan, F.col("source").eqNullSafe(F.col("__s")) & (F.col("shard") == F.col("__h"))) \
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))) \
        .withColumn("start", F.col("at") + F.col("copy") * F.col("size")).withColumn("stop", F.col("start") + F.col("size")) \
        .withColumn("taken", F.expr(f"{up_to('stop')} - ({up_to('start')})"))
    none = placed.where("size = 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))) \
        .withColumn("taken", F.lit(0).cast("long"))
    for c in ("start", "stop", "blocks", "quota"):
        none = none.withColumn(c, F.lit(None).cast("long"))
    cols = ["doc_id", "source", "size", F.col("words").alias("source_size"), "target", "taken", "shard", "start", "stop",
            "blocks", "quota"]
    return out.select(*cols).unionByName(none.select(*cols))


#: The same by listing every seat, which a small table allows.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source),
s1 AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS weight,
  row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s0),
s2 AS (SELECT *, CAST(coalesce(sum(words) OVER w, 0) AS BIGINT) AS stopped, CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS BIGINT) AS free,
  CAST(sum(words) OVER () AS BIGINT) AS whole FROM s1
  WINDOW w AS (ORDER BY CAST(words AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (1.5::DOUBLE * whole - 2 * stopped) / free AS level, row_number() OVER (ORDER BY CAST(words AS DOUBLE) / weight, place) AS turn FROM s2),
lv AS (SELECT arg_min(level, turn) AS level FROM s3 WHERE level * weight <= 2 * words),
s AS (SELECT s3.source, words, whole, place, least(2 * words::DOUBLE, weight * lv.level) AS target,
  CAST(ceil(words / {SHARD_WORDS}::DOUBLE) AS BIGINT) AS shards FROM s3, lv),
p AS (SELECT d.*, s.words, s.target, s.place, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size) AS h, shards
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
t AS (SELECT *, CASE WHEN size > 0 THEN CAST('0x' || substr(reverse(h), 1, 8) AS BIGINT) % greatest(shards, 1) END AS shard FROM p),
a AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY place, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM t),
c AS (SELECT place, any_value(source) AS source, shard, any_value(target) AS target, CAST(sum(size) AS BIGINT) AS votes,
  CAST(ceil(sum(size) / {BLOCK}::DOUBLE) AS BIGINT) AS blocks FROM a WHERE size > 0 GROUP BY place, shard),
o AS (SELECT place, any_value(target) AS target, CAST(sum(blocks) AS BIGINT) AS blocks FROM c GROUP BY place),
q1 AS (SELECT place, unnest(range(2 * blocks)) AS k, target FROM o),
q2 AS (SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k) AS r FROM q1),
q3 AS (SELECT place, count(*) AS seats FROM q2 WHERE r <= (SELECT round(1.5::DOUBLE * any_value(whole) / {BLOCK}) FROM s) GROUP BY place),
r1 AS (SELECT place, shard, unnest(range(2 * blocks)) AS k, votes FROM c),
r2 AS (SELECT place, shard, row_number() OVER (PARTITION BY place ORDER BY votes::DOUBLE / (2 * k + 1) DESC, shard, k) AS r FROM r1),
r3 AS (SELECT r2.place, shard, count(*) AS quota FROM r2 JOIN q3 ON r2.place = q3.place WHERE r <= seats GROUP BY r2.place, shard),
e AS (SELECT c.place, c.shard, blocks, coalesce(quota, 0) AS quota,
  CAST('0x' || substr(md5('{SEED}|' || coalesce(c.source, '') || '|' || c.shard), 1, 8) AS BIGINT) % blocks AS first
  FROM c LEFT JOIN r3 ON c.place = r3.place AND c.shard = r3.shard),
f AS (SELECT a.*, quota, blocks, first, start + size AS stop FROM a LEFT JOIN e ON a.place = e.place AND a.shard = e.shard)
SELECT doc_id, size, words AS source_size, target, CASE WHEN size = 0 THEN CAST(0 AS BIGINT) ELSE CAST(
  {BLOCK} * (((stop // {BLOCK}) * quota + first) // blocks) + (stop % {BLOCK}) * (((stop // {BLOCK} + 1) * quota + first) // blocks - ((stop // {BLOCK}) * quota + first) // blocks)
  - {BLOCK} * (((start // {BLOCK}) * quota + first) // blocks) - (start % {BLOCK}) * (((start // {BLOCK} + 1) * quota + first) // blocks - ((start // {BLOCK}) * quota + first) // blocks)
  AS BIGINT) END AS taken FROM f"""
