"""Retrieval quality of ranked lists against graded judgments, and latency percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def metrics(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """query_id, hit, rr, ndcg at k. ranked: query_id, id, rank; judged: query_id, id, grade.

    Grades of 2 and more are relevant, with a gain of 2**grade - 1; the first row of an id in a list counts.
    """
    first = ranked.groupBy("query_id", "id").agg(F.min("rank").alias("rank")).where(F.col("rank") <= k)
    gain = F.when(F.col("grade") >= 2, F.pow(F.lit(2.0), F.col("grade")) - 1).otherwise(0.0)
    best = W.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    ideal = judged.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("query_id").agg(F.sum(gain / F.log2(F.col("r") + 1)).alias("ideal"))
    got = first.join(judged, ["query_id", "id"]).groupBy("query_id").agg(F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"), F.min(F.when(F.col("grade") >= 2, F.col("rank"))).alias("top"))
    out = ideal.join(got, "query_id", "left")
    return out.select("query_id", F.when(F.col("top").isNotNull(), 1).otherwise(0).alias("hit"), F.coalesce(1 / F.col("top"), F.lit(0.0)).alias("rr"), F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def nearest_rank(values: Column, p: float) -> Column:
    """The value at the rounded rank p * (n - 1) of a list."""
    return F.get(F.sort_array(values), F.round(F.lit(p) * (F.size(values) - 1)).cast("int"))
