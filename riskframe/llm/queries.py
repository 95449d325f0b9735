"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, exact_dedup, licenses, line_dedup, lm, mixing, packing, periodic, simhash, spelling, toxicity
from .common import read


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


#: The special token of the 50k vocabulary.
SPECIAL_50K = {"<|endoftext|>": 50256}


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.rank_lines(spark, _vocabulary("byte_bpe_50k.tiktoken"))
    return packing.pack_documents(read(spark, sf_dir, "documents"), ranks, pattern(), SPECIAL_50K)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.rank_lines(spark, _vocabulary("byte_bpe_multi_50k.tiktoken"))
    return bpe.bpe_round_trip(read(spark, sf_dir, "documents"), ranks, pattern())


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_templates(read(spark, sf_dir, "documents")) \
        .withColumn("dropped", F.array_join(F.col("dropped").cast("array<string>"), ","))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(chat.with_probe(read(spark, sf_dir, "conversations")))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(read(spark, sf_dir, "documents"), slips=True)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(read(spark, sf_dir, "documents"), plant=True)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_lm_score": op5_lm_score,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_chat_format": op9_chat_format,
    "op10_ann": op10_ann,
    "op11_spelling_groups": op11_spelling_groups,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_mixing": op13_mixing,
}

ORACLES = {
    "op1_license_scan": licenses.ORACLE,
    "op6_exact_dedup": OP6_SQL,
    "op9_chat_format": chat.ORACLE,
    "op13_mixing": mixing.ORACLE,
}
