"""A corpus pipeline in five stages, from documents to token ids.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; all
but the last return the columns of documents. A stage may write to the folder
in spark.checkpoint.dir, and reads only the rows that the stage before it kept
(and the benchmark table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import blocks, bpe, decontaminate, langid, neardup, suffixes
from sparkloom.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without letters, and noise, go."""
    models = langid.fit(docs, blocks.fold(F.col("doc_id"), 5) != 0)
    return langid.accepted(docs, models) if models else docs


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates."""
    return neardup.representatives(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat earlier ones; what is left of documents stays, empty ones too."""
    return suffixes.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of ids and of the bytes that they decode to."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_bytes=False)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

#: Automata, MinHash and merges are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
