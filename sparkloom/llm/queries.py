"""The queries of this folder: names, functions of (spark, sf_dir), SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, bpe, decontaminate, html, knn, langid, neardup, ngrams, quality, suffixes, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of nine folds in ten."""
    return ngrams.score(documents(spark, sf_dir), blocks.fold(F.col("doc_id"), 10) == 0)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in which a test item was found, with the item and the overlaps."""
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from four folds in five."""
    docs = documents(spark, sf_dir)
    held_out = blocks.fold(F.col("doc_id"), 5) == 0
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suffix dedup leaves of every document."""
    return suffixes.digests(documents(spark, sf_dir))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document."""
    return neardup.classes(documents(spark, sf_dir))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels of four folds in five."""
    docs = documents(spark, sf_dir)
    held_out = blocks.fold(F.col("doc_id"), 5) == 0
    score = quality.fit_predict(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", ~held_out)
    return score.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes, for every document."""
    import public_tokenizers

    return bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False, with_bytes=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels of three folds in four."""
    docs = documents(spark, sf_dir)
    held_out = blocks.fold(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", ~held_out)
    score = toxicity.predict(docs, model)
    return score.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by inner product of each vector whose id is divisible by 100."""
    return knn.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngrams": op1_ngrams,
    "op2_decontaminate": op2_decontaminate,
    "op3_langid": op3_langid,
    "op4_suffixes": op4_suffixes,
    "op5_neardup": op5_neardup,
    "op6_html": op6_html,
    "op7_quality": op7_quality,
    "op8_bpe": op8_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_knn": op10_knn,
}

ORACLE_SQL: dict[str, str] = {"op4_suffixes": suffixes.ORACLE_SQL, "op5_neardup": neardup.ORACLE_SQL, "op10_knn": knn.ORACLE_SQL}
