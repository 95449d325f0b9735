"""Line dedup with a log-template tree.

A line's tokens that hold a digit are variable fields (``<*>``). The tree has
a fixed depth: token count, then the ``DEPTH`` leading tokens. In a leaf a line
joins the best template that agrees with it in at least ``SIMILARITY`` of all
positions (a field agrees with nothing); positions where they differ become
fields of the template. Otherwise it starts a template. Different lines come
to a leaf in sorted order, so the templates don't depend on how the input is
dealt out.

A line and a template that differ in at most e positions agree in at least one
of e + 1 consecutive blocks of positions; the leaf looks templates up by
block, so its work grows with its lines, not with lines times templates.

1. Every input partition collapses equal masked lines, so that a very common
   line leaves it once, and numbers them. The table is bounded: it is sent on
   when it is full.
2. What is left is dealt out by leaf and put into the tree.
3. Templates held by at least ``min_docs`` different texts recur; their lines
   are found by the numbers that the first step gave them, and dropped, all but
   the first of each template.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, keep_rows, rows, stored, text_or_empty

DEPTH = 3
SIMILARITY = 0.8
#: Different texts that make a template recur.
MIN_DOCS = 2
FIELD = "<*>"
#: Characters of masked lines that a task holds before it sends them on.
HOLD_CHARS = 24 << 20
#: Whole texts that pass between Spark and a task at a time.
BATCH_ROWS = 512

_DIGIT = re.compile(r"\d")


def mask(line: str) -> str:
    """Tokens joined by single spaces; those with a digit as ``<*>``."""
    tokens = line.split()
    if _DIGIT.search(line) is not None:
        tokens = [FIELD if _DIGIT.search(t) else t for t in tokens]
    return " ".join(tokens)


class Leaf:
    """Templates of one leaf (lines of one token count and one beginning)."""

    def __init__(self, similarity: float = SIMILARITY):
        self.similarity = similarity
        self.templates: list[list[str]] = []
        self.blocks: dict[tuple, list[int]] = {}

    def add(self, tokens: list[str]) -> int:
        """Number of the template that the line joins or starts."""
        n = len(tokens)
        miss = int(n * (1 - self.similarity) + 1e-9)          # positions that may differ
        cut = [n * i // (miss + 1) for i in range(miss + 2)]
        keys = [(a, *tokens[a:b]) for a, b in zip(cut, cut[1:])]
        found = {t for key in keys for t in self.blocks.get(key, ())}
        best = (miss + 1, 0)
        for t in found:
            off = sum(x != y or x == FIELD for x, y in zip(self.templates[t], tokens))
            best = min(best, (off, t))
        if best[0] <= miss:
            t = best[1]
            if best[0]:
                self.templates[t] = [x if x == y else FIELD for x, y in zip(self.templates[t], tokens)]
            return t
        t = len(self.templates)
        self.templates.append(tokens)
        for key in keys:
            if FIELD not in key:
                self.blocks.setdefault(key, []).append(t)
        return t


_LOCAL = pa.schema([("line", pa.string()), ("docs", pa.int64()), ("no", pa.int64()), ("row", pa.int64()),
                    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("nos", pa.list_(pa.int64()))])
_LOCAL_DDL = "line string, docs long, no long, row long, doc_id long, text_key long, nos array<long>"
_JOINED = pa.schema([("no", pa.int64()), ("template", pa.int64()), ("docs", pa.int64()), ("text", pa.string())])
_JOINED_DDL = "no long, template long, docs long, text string"


def _number_lines(batches):
    base = TaskContext.get().partitionId() << 32
    table: dict[str, list] = {}          # masked line -> [number, documents, last document]

    def flush():
        for line, (no, docs, _) in table.items():
            yield line, docs, no, None, None, None, None
        table.clear()

    def out():
        held = made = 0
        for row, (doc, key, text) in enumerate(rows(batches), base):
            nos = []
            for raw in text.split("\n"):
                line = mask(raw)
                if not line:
                    nos.append(None)
                    continue
                got = table.get(line)
                if got is None:
                    got = table[line] = [base + made, 1, row]
                    made += 1
                    held += len(line) + 200
                elif got[2] != row:
                    got[1:] = got[1] + 1, row
                nos.append(got[0])
            yield None, None, None, row, doc, key, nos
            if held > HOLD_CHARS:
                yield from flush()
                held = 0
        yield from flush()

    return batches_of(out(), _LOCAL, weigh=lambda r: 200 + len(r[0] or "") + 48 * len(r[6] or ""))


def _tree(similarity: float, min_docs: int):
    """Per number: its template and an upper bound of the template's documents,
    for the templates that may recur. Rows come sorted by leaf and line."""
    def run(batches):
        def out():
            at, leaf, last, counts, members = None, None, None, [], []
            for name, line, docs, no in rows(batches):
                if name != at:
                    yield from recurring(leaf, counts, members)
                    at, leaf, last, counts, members = name, Leaf(similarity), None, [], []
                if line != last:
                    last, t = line, leaf.add(line.split(" "))
                    if t == len(counts):
                        counts.append(0)
                        members.append([])
                counts[t] += docs
                members[t].append(no)
            yield from recurring(leaf, counts, members)

        def recurring(leaf, counts, members):
            for t, docs in enumerate(counts):
                if docs >= min_docs:
                    first, text = min(members[t]), " ".join(leaf.templates[t])
                    for no in members[t]:
                        yield no, first, docs, text if no == first else None

        return batches_of(out(), _JOINED)
    return run


@contextmanager
def _few_rows(spark):
    """Arrow batches of ``BATCH_ROWS`` rows for what runs inside: by default a
    batch holds 10,000 whole texts, once in Spark and once in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def line_templates(docs: DataFrame, *, depth: int = DEPTH, similarity: float = SIMILARITY,
                   min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per input row: ``doc_id``, ``text_key`` (hash of the text),
    ``n_lines`` (lines, blank ones too), ``n_dropped``, ``dropped`` (numbers
    from 0 of the lines to drop, in order).

    A template recurs if at least ``min_docs`` different texts hold it: repeated
    rows and exact copies count once. Of a recurring template's lines the one
    with the smallest (doc_id, text_key, number) stays, in every row that
    repeats that document; a NULL doc_id counts as the largest. So every
    template stays somewhere, and no text loses a line to its own copies alone.
    Blank lines are never dropped. NULL text is empty (one blank line); an empty
    table gives no row; other columns are not read. Lines end at LF."""
    text = text_or_empty()
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    with _few_rows(docs.sparkSession):
        local = stored(src.mapInArrow(_number_lines, _LOCAL_DDL), "lines")
    count = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    leaf = F.concat_ws(" ", count.cast("string"), F.substring_index("line", " ", depth))
    named = local.where("line IS NOT NULL").select(leaf.alias("leaf"), "line", "docs", "no") \
        .repartition("leaf").sortWithinPartitions("leaf", "line", "no") \
        .mapInArrow(_tree(similarity, min_docs), _JOINED_DDL).select("no", "template")
    per_doc = local.where("row IS NOT NULL")
    hits = per_doc.select("row", "doc_id", "text_key", F.posexplode("nos").alias("pos", "no")).where("no IS NOT NULL").join(named, "no")
    hits = stored(hits.select("row", "doc_id", "text_key", "pos", "template"), "line-hits")
    # one row per text first: the bound counts a text twice if two of its
    # different lines join one template
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "pos")
    recur = hits.groupBy("template", "text_key").agg(F.min(place).alias("first")) \
        .groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).where(F.col("n") >= min_docs) \
        .select("template", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "text_key", "pos")])
    # written, so that the join deals both sides out anew and Spark can split a
    # very common template
    recur = stored(recur, "line-templates")
    stays = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("text_key") == F.col("first_text_key")) & (F.col("pos") == F.col("first_pos"))
    dropped = hits.join(recur, "template").where(~stays).groupBy("row").agg(F.array_sort(F.collect_list("pos")).alias("dropped"))
    return per_doc.join(dropped, "row", "left").select(
        "doc_id", "text_key", F.size("nos").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, all columns, without the recurring lines (one row for
    rows that repeat a document)."""
    found = line_templates(docs, **options).groupBy("doc_id", "text_key").agg(F.first("dropped").alias("__dropped"))
    key = F.xxhash64(text_or_empty())
    once = keep_rows(docs, found.select("doc_id", F.col("text_key").alias("key")), key)
    j = once.withColumn("__key", key).join(
        found.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__k"), "__dropped"),
        F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__key") == F.col("__k")))
    kept = F.filter(F.split(text_or_empty(), "\n"), lambda x, i: ~F.array_contains("__dropped", i))
    return j.withColumn("text", F.when(F.size("__dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))) \
        .select(*docs.columns)
