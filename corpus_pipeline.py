"""Documents to token ids: quality rules, near-duplicate removal, decontamination, pseudonyms, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
``docs`` of the next one. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import bpe, decontaminate, jaccard, pii, quality
from sensorloom.llm.common import stage

# The quality verdict comes from a fitted language model, which SQL can't express.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the base rules and the perplexity band of their language stay."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 on five-word shingles, the document with the smallest id
    stays. Rows are told apart by (id, text); a null id comes first; equal rows stay or go together."""
    own = docs.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("row"), "text")
    found = jaccard.link_components(own, "row", words=5, percent=80)
    gone = found.where("row != component_id").select(F.col("row.doc_id").alias("gone_id"), F.col("row.hash").alias("gone_hash")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window that matches a benchmark item go."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers, dates and addresses of people get pseudonyms of the same format."""
    return pii.pseudonymise(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (packed little-endian unsigned 32-bit integers) and ``text``, decoded from the ids."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(docs, path, pattern).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pseudonyms", pseudonyms),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
