"""Where derived rows come from, integrity checks, counts, and summaries' input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import VERSIONS

COLUMNS = ["artifact_type", "artifact_id", "document_id", "chunk_id", "start_offset", "end_offset", "extractor", "version"]


def of_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.lit("chunk").alias("artifact_type"), F.col("id").cast("string").alias("artifact_id"), "document_id", F.col("id").alias("chunk_id"), "start_offset", "end_offset", F.lit("chunker").alias("extractor"), F.lit(VERSIONS["chunker"]).alias("version"))


def of_mentions(mentions: DataFrame) -> DataFrame:
    return mentions.select(F.lit("entity_mention").alias("artifact_type"), F.concat_ws(":", "chunk_id", "key").alias("artifact_id"), "document_id", "chunk_id", "start_offset", "end_offset", F.lit("entities").alias("extractor"), F.lit(VERSIONS["entities"]).alias("version"))


def of_claims(claims: DataFrame) -> DataFrame:
    return claims.select(F.lit("claim").alias("artifact_type"), F.col("claim_id").cast("string").alias("artifact_id"), "document_id", "chunk_id", "start_offset", "end_offset", F.lit("claims").alias("extractor"), F.lit(VERSIONS["claims"]).alias("version"))


def table(chunks: DataFrame, mentions: DataFrame, claims: DataFrame) -> DataFrame:
    return of_chunks(chunks).unionByName(of_mentions(mentions)).unionByName(of_claims(claims))


def export(provenance: DataFrame) -> DataFrame:
    """document_id and a JSON object of its artifacts by type."""
    rows = provenance.groupBy("document_id", "artifact_type").agg(F.sort_array(F.collect_list(F.struct("artifact_id", "chunk_id", "start_offset", "end_offset", "extractor", "version"))).alias("rows"))
    whole = rows.groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("artifact_type", "rows")))).alias("artifacts"))
    return whole.select("document_id", F.to_json("artifacts").alias("json"))


def first_of(provenance: DataFrame, kind: str) -> DataFrame:
    """The first provenance row of each artifact of a type."""
    order = W.partitionBy("artifact_id").orderBy("document_id", "chunk_id", "start_offset")
    return provenance.where(F.col("artifact_type") == kind).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def counts(**tables: DataFrame) -> DataFrame:
    """name and rows of each table, in one job."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose parent is missing."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def summary_input(chunks: DataFrame, most: int = 10, size: int = 3000) -> DataFrame:
    """document_id and the text that a summary is made of: the first chunks until more than ``size`` bytes, cut to ``size`` characters."""
    order = W.partitionBy("document_id").orderBy("chunk_index")
    before = F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = chunks.where(F.col("chunk_index") < most).withColumn("before", before).where(F.col("before") <= size)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("document_id").agg(F.left(text, F.lit(size)).alias("text"))
