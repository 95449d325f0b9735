"""Exact dedup by Patricia-trie owners.

1. Every input partition puts its normalised texts, as full byte strings, into
   a compressed radix trie. A terminal node holds the smallest doc_id and the
   number of rows that ended there, so a text held by a third of all rows
   leaves each partition once.
2. What is left is dealt out by (byte length, content hash). Each partition
   puts its byte strings into one trie again; the terminal nodes now hold the
   owner (smallest doc_id) and size of every group.
3. Documents look up their owner by the SHA-256 of the text; Spark splits a
   hot digest in that join (AQE skew join).

A trie is bounded: beyond ``budget`` bytes its largest subtree goes to a
private temporary file, later strings that reach that subtree are appended to
the file, and the file is worked off as a trie of its own at the end.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, batches_of, rows, text_or_empty

#: Bytes of labels and nodes a task's trie may hold before it spills.
TRIE_BYTES = 96 << 20
_NODE_BYTES = 300


class _Node:
    __slots__ = ("kids", "value", "spill")

    def __init__(self, value=None):
        self.kids: dict[int, list] = {}   # first byte -> [label, node]
        self.value = value                # (smallest id, rows, payload) at a terminal node
        self.spill = None                 # file that has this subtree's entries


def _merge(a, b):
    """Terminal values: smallest non-NULL id, sum of rows."""
    if a is None:
        return b
    ids = [x for x in (a[0], b[0]) if x is not None]
    return (min(ids) if ids else None, a[1] + b[1], a[2])


def _common(label: bytes, key: bytes, pos: int) -> int:
    """Length of the common prefix of ``label`` and ``key[pos:]`` (bisection
    over slice comparisons, which run in C)."""
    lo, hi = 0, min(len(label), len(key) - pos)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if key.startswith(label[lo:mid], pos + lo):
            lo = mid
        else:
            hi = mid - 1
    return lo


class PatriciaTrie:
    """Compressed radix trie over byte strings with a byte budget."""

    def __init__(self, budget: int = TRIE_BYTES):
        self.root, self.budget, self.held = _Node(), budget, 0

    def insert(self, key: bytes, value: tuple) -> None:
        node, pos = self.root, 0
        while True:
            if node.spill is not None:
                pickle.dump((key[pos:], value), node.spill)
                return
            if pos == len(key):
                node.value = _merge(node.value, value)
                return
            edge = node.kids.get(key[pos])
            if edge is None:
                node.kids[key[pos]] = [key[pos:], _Node(value)]
                self.held += len(key) - pos + _NODE_BYTES
                break
            label, child = edge
            if key.startswith(label, pos):
                node, pos = child, pos + len(label)
                continue
            cut = _common(label, key, pos)
            mid = _Node()
            mid.kids[label[cut]] = [label[cut:], child]
            edge[0], edge[1] = label[:cut], mid
            self.held += _NODE_BYTES
            node, pos = mid, pos + cut
        while self.held > self.budget and self._spill_one():
            pass

    def _weight(self, node: _Node) -> int:
        total, todo = 0, [node]
        while todo:
            n = todo.pop()
            for label, child in n.kids.values():
                total += len(label) + _NODE_BYTES
                todo.append(child)
        return total

    def _spill_one(self) -> bool:
        """Move the largest subtree at the first branching node to a file.
        False if there is no subtree left to move."""
        node = self.root
        while len(node.kids) == 1 and node.value is None:
            node = next(iter(node.kids.values()))[1]
            if node.spill is not None:
                return False
        sizes = [(self._weight(child), first) for first, (_, child) in node.kids.items()
                 if child.spill is None and child.kids]
        if not sizes:
            return False
        weight, first = max(sizes)
        child = node.kids[first][1]
        out = tempfile.TemporaryFile()
        for suffix, value in _walk(child, b""):
            pickle.dump((suffix, value), out)
        child.kids, child.value, child.spill = {}, None, out
        self.held -= weight
        return True

    def entries(self) -> Iterator[tuple[bytes, tuple]]:
        """(byte string, terminal value) of everything inserted; spilled
        subtrees are rebuilt one at a time."""
        spilled = []
        yield from _walk(self.root, b"", spilled)
        self.root = _Node()
        for prefix, file in spilled:
            sub = PatriciaTrie(self.budget)
            for suffix, value in _records(file):
                sub.insert(suffix, value)
            file.close()
            for suffix, value in sub.entries():
                yield prefix + suffix, value


def _walk(node: _Node, prefix: bytes, spilled: list | None = None):
    todo = [(node, prefix)]
    while todo:
        n, p = todo.pop()
        if n.spill is not None:
            if spilled is None:
                yield from ((p + s, v) for s, v in _records(n.spill))
                n.spill.close()
            else:
                spilled.append((p, n.spill))
            continue
        if n.value is not None:
            yield p, n.value
        todo.extend((child, p + label) for label, child in n.kids.values())


def _records(file):
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def trie_owners(items: Iterable[tuple[bytes, tuple]], budget: int = TRIE_BYTES):
    """Distinct byte strings of ``items`` with (smallest id, rows, payload)."""
    trie = PatriciaTrie(budget)
    for key, value in items:
        trie.insert(key, value)
    return trie.entries()


def normalised(text: Column) -> Column:
    """Every run of white space becomes one space. (A single space stays as it
    is, so the pattern skips it.)"""
    return F.regexp_replace(text, rf"[{SPACE_CLASS}]{{2,}}|[\x09-\x0D]", " ")


_TEXTS = pa.schema([("text", pa.binary()), ("sha", pa.string()), ("id", pa.int64()), ("n", pa.int64())])
_OWNERS = pa.schema([("sha", pa.string()), ("id", pa.int64()), ("n", pa.int64())])


def _map_side(budget):
    def run(batches):
        items = ((text, (i, n, sha)) for text, sha, i, n in rows(batches))
        return batches_of(((k, v[2], v[0], v[1]) for k, v in trie_owners(items, budget)), _TEXTS,
                          weigh=lambda r: len(r[0]))
    return run


def _final(budget):
    def run(batches):
        items = ((text, (i, n, sha)) for text, sha, i, n in rows(batches))
        return batches_of(((v[2], v[0], v[1]) for _, v in trie_owners(items, budget)), _OWNERS)
    return run


def exact_owners(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 budget: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: ``sha``, ``id`` (owner), ``n``
    (rows of the group)."""
    norm = docs.select(normalised(text_or_empty(text_col)).alias("t"), F.col(id_col).cast("long").alias("id"))
    src = norm.select(F.col("t").cast("binary").alias("text"), F.sha2("t", 256).alias("sha"), "id",
                      F.lit(1).cast("long").alias("n"))
    local = src.mapInArrow(_map_side(budget), "text binary, sha string, id long, n long")
    dealt = local.repartition(F.octet_length("text"), F.xxhash64("text"))
    return dealt.mapInArrow(_final(budget), "sha string, id long, n long")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                budget: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` (normalised text).

    Texts are equal when identical after white-space runs became one space;
    NULL is the empty text. The row with the smallest doc_id stays; NULL ids
    come last. Rows repeated with one doc_id and one text count in
    ``group_size`` and exactly one of them is kept. An empty table gives an
    empty result. Other columns are not read."""
    owners = exact_owners(docs, id_col=id_col, text_col=text_col, budget=budget) \
        .select(F.col("sha").alias("owner_sha"), F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    members = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                          F.sha2(normalised(text_or_empty(text_col)), 256).alias("text_sha256"))
    # one of the rows that repeat a (doc_id, text); such groups are tiny
    again = Window.partitionBy("doc_id", "text_sha256").orderBy("doc_id")
    members = members.withColumn("copy", F.row_number().over(again))
    j = members.join(owners, F.col("text_sha256") == F.col("owner_sha"))
    return j.select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                    "text_sha256")
