"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows turned into Python objects at a time inside a task, so that a batch of
#: very long texts is never held twice.
SLICE_ROWS = 256

#: White space of the text contracts: space, tab, LF, VT, FF, CR.
SPACE_CLASS = r"\x20\x09-\x0D"


def text_or_empty(name: str = "text") -> Column:
    """The text column; NULL counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, ``SLICE_ROWS`` at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            yield from zip(*(c.to_pylist() for c in part.columns))


def batches_of(records: Iterator[tuple], schema: pa.Schema, size: int = 4096,
               max_bytes: int = 16 << 20, weigh=None) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most ``size`` rows; with ``weigh`` (bytes
    of a tuple) a batch also ends at about ``max_bytes``."""
    buf, held = [], 0
    for r in records:
        buf.append(r)
        held += weigh(r) if weigh else 0
        if len(buf) >= size or held >= max_bytes:
            yield _batch(buf, schema)
            buf, held = [], 0
    if buf:
        yield _batch(buf, schema)


def _batch(buf: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*buf))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the cluster's shared checkpoint folder and
    read it back: cuts the lineage, survives lost executors, and is compressed
    (unlike an RDD checkpoint)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_rows(docs: DataFrame, kept: DataFrame, key: Column) -> DataFrame:
    """Rows of ``docs`` (all columns) whose (doc_id, key) is in ``kept``
    (columns ``doc_id``, ``key``; no repeats), one row for each of them:
    repeated rows of one document with one key collapse to the smallest.

    The texts move once: the join and the window share their keys, which are
    never NULL. The join is a merge join at every size (``kept`` grows with the
    table)."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    keys = ["__id", "__none", "__key"]

    def keyed(df, k, columns):
        return df.select(*columns, F.coalesce(F.col("doc_id"), F.lit(0)).alias("__id"),
                         F.col("doc_id").isNull().alias("__none"), k.alias("__key"))

    j = keyed(docs, key, names).join(keyed(kept, F.col("key"), []).hint("merge"), keys, "left_semi")
    w = Window.partitionBy(*keys).orderBy(*names)
    return j.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(*names)
