import random
import re

import duckdb
import pytest
from helpers_llm import EDGE, edge_docs, empty_docs, rows_of
from pyspark.sql import functions as F
from riskframe.llm import mixing


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def by_code_point(sources):
    return sorted(sources, key=lambda s: (s is None, (s or "").encode()))


def water_level(sources, weights=(3, 1, 2), factor=1.5, repeats=2):
    """Targets by resharing the excess until none is above."""
    names = by_code_point(sources)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        free = sum(weight[s] for s in names if s not in full)
        left = factor * sum(sources.values()) - repeats * sum(sources[s] for s in full)
        level = left / free if free else 0.0
        more = {s for s in names if s not in full and weight[s] * level > repeats * sources[s]}
        if not more:
            return {s: repeats * float(sources[s]) if s in full else weight[s] * level for s in names}
        full |= more


def sainte_lague(votes, caps, seats):
    """One seat after the other to the highest quotient."""
    got = {k: 0 for k in votes}
    for _ in range(seats):
        open_ = [k for k in votes if votes[k] > 0 and got[k] < caps[k]]
        if not open_:
            break
        got[min(open_, key=lambda k: (-votes[k] / (2 * got[k] + 1), k))] += 1
    return got


@pytest.mark.parametrize("caps", [None, "some"])
def test_apportion_matches_seat_by_seat(spark, caps):
    rng = random.Random(9)
    rows, want = [], {}
    for g, size in (("a", 1), ("b", 7), (None, 40), ("zero", 3)):
        votes = {k: 0.0 if g == "zero" else float(rng.choice([0, 1, 5, 5, 70, 900, 9000])) for k in range(size)}
        cap = {k: rng.randrange(1, 9) if caps else 10_000 for k in votes}
        seats = rng.randrange(1, 120)
        for k, q in sainte_lague(votes, cap, seats).items():
            want[g, k] = q
            rows.append((g, k, votes[k], cap[k], seats))
    df = spark.createDataFrame(rows, "g string, k long, votes double, cap long, seats long")
    got = {(r.g, r.k): r.quota for r in mixing.apportion(df, ["g"], ["k"], "t").collect()}
    assert got == want


def check_mix(rows, slack):
    """``rows``: (doc_id, source, size, source_size, target, taken)."""
    totals, taken = {}, {}
    for _, s, size, _, _, n in rows:
        totals[s] = totals.get(s, 0) + size
        taken[s] = taken.get(s, 0) + n
        assert 0 <= n <= 2 * size
    want = water_level(totals)
    for _, s, _, words, target, _ in rows:
        assert words == totals[s] and target == pytest.approx(want[s], rel=1e-12)
    for s in totals:
        assert abs(taken[s] - want[s]) <= slack + 0.02 * want[s], s


def test_targets_and_taken(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(d).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    sizes = sorted((r.doc_id, n_words(r.text)) for r in d.collect())
    assert sorted((r.doc_id, r["size"]) for r in got) == sizes
    check_mix([tuple(r) for r in got], 2 * mixing.BLOCK)


def test_many_shards_one_large_source(spark):
    """A source with most rows, cut into many shards; quotas add up to the
    blocks of all; reruns and other partitions agree."""
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else rng.choice(["b", "a", "zz", None, "é"]), "w " * rng.choice([0, 1, 9, 80, 400])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    options = {"block": 8, "shard_words": 1000}
    cols = ["doc_id", "source", "size", "source_size", "target", "taken"]
    made = mixing.mix(df.repartition(7), **options)
    got = sorted(rows_of(made.select(*cols)), key=str)
    check_mix(got, 16)
    cells = made.where("size > 0").select("source", "shard", "quota", "blocks", "target").distinct().collect()
    assert len(cells) > 100 and all(0 <= c.quota <= 2 * c.blocks for c in cells)
    words = sum(r[2] for r in got)
    assert sum(c.quota for c in cells) == round(1.5 * words / 8)
    assert got == sorted(rows_of(mixing.mix(df.repartition(3, F.col("text")), **options).select(*cols)), key=str)
    assert got != sorted(rows_of(mixing.mix(df, seed=99, **options).select(*cols)), key=str)


def test_taken_words_are_the_picked_blocks(spark):
    """From the tape: block b is taken as often as the docstring's formula says."""
    rows = [(i, "s" if i % 2 else "t", "w " * (i * 7 % 23)) for i in range(60)]
    made = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block=4, shard_words=150)
    spans = {}
    for r in made.where("size > 0").collect():
        spans.setdefault((r.source, r.shard), []).append(r)
    for cell in spans.values():
        cell.sort(key=lambda r: r.start)
        assert [r.start for r in cell[1:]] == [r.stop for r in cell[:-1]] and cell[0].start == 0
        q, n = cell[0].quota, cell[0].blocks
        # the first block is not in the result: one of them explains every document
        def taken(first):
            times = [((b + 1) * q + first) // n - (b * q + first) // n for b in range(n)]
            return [sum(times[w // 4] for w in range(r.start, r.stop)) for r in cell]
        assert any(taken(f) == [r.taken for r in cell] for f in range(n))


def test_sql_with_skew_and_edges(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(["x"] * 6 + ["y", "é", None, "Z", "tiny"]), " ".join(["t"] * rng.choice([0, 1, 50, 700])) or None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    df.toPandas().to_parquet(f"{tmp_path}/d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall()
    assert sorted(rows_of(mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken"))) == sorted(want)


def test_edge_rows(spark):
    d = edge_docs(spark, EDGE).withColumn("source", F.col("lang"))
    got = rows_of(mixing.mix(d).select("doc_id", "source", "size", "source_size", "target", "taken"))
    assert len(got) == len(EDGE)
    check_mix(got, 2 * mixing.BLOCK)
    twice = [r for r in got if r[0] == 9]
    assert len(twice) == 2 and {r[2] for r in twice} == {3}
    assert rows_of(mixing.mix(empty_docs(spark).withColumn("source", F.col("lang")))) == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in mixing.mix(blank).collect()) == \
        [(1, 0, 0.0, 0), (2, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_repeated_rows_stand_one_after_another(spark):
    rows = [(1, "a", "w " * 30)] * 40 + [(2, "b", "w " * 300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block=10, shard_words=100).collect()
    ones = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.start)
    assert [r.start for r in ones] == [30 * i for i in range(40)]
    assert all(r.taken <= 60 for r in ones)
