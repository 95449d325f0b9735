"""The corpus pipeline: toxicity, exact dedup, near dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the
last return the columns of ``docs``; :func:`run` writes each result as Parquet
into the cluster's shared checkpoint folder and rereads it for the next stage,
so a lost executor costs one stage at most. Stages read nothing of ``docs`` but
``doc_id`` and ``text``; other columns pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import exact_dedup, packing, queries, simhash, toxicity
from riskframe.llm.bpe import rank_lines
from riskframe.llm.common import keep_rows, read, stored, text_or_empty

#: Not expressible in SQL (fitted model, fingerprints, packing order).
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    kept = exact_dedup.exact_dedup(docs).where("kept").select("doc_id", F.col("text_sha256").alias("key"))
    return keep_rows(docs, kept, F.sha2(exact_dedup.normalised(text_or_empty()), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the smallest doc_id stays (contract's shingle
    length and bit distance)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key"))
    kept = simhash.simhash_components(docs).groupBy("root").agg(first.alias("x")) \
        .select("x.doc_id", F.col("x.text_key").alias("key"))
    return keep_rows(docs, kept, F.xxhash64(text_or_empty()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack_documents(docs, rank_lines(spark, queries._vocabulary("byte_bpe_50k.tiktoken")),
                                  queries.pattern(), queries.SPECIAL_50K)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
