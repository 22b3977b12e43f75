"""The corpus pipeline: quality rules, MinHash near-dedup, benchmark decontamination, PII, byte-level BPE.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet in the folder that the cluster shares and reads again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, decontaminate, neardup, pii, quality

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; cutoffs come from the labels of the documents at hand."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels")).select(*COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return neardup.keep_first(docs).select(*COLUMNS)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty stands in a benchmark passage."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind."""
    found = pii.detect(docs, whole=True)
    clean = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return found.select(*(clean.get(c, F.col(f"row.{c}")).alias(c) for c in COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256) of each document."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    found = bpe.encode(docs, path, pattern, keep=("lang", "source"), digest=True)
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality_rules", keep_quality),
    ("minhash_neardup", keep_distinct),
    ("decontamination", keep_uncontaminated),
    ("pii", hide_personal_data),
    ("byte_bpe", encode),
]

#: The near-duplicate components, the votes on personal data and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
