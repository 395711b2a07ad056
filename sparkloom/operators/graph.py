"""Neighbourhoods, breadth-first traversal and degrees over undirected weighted edges (source, target, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end (node, other, weight): two equi-joins later instead of one with an OR."""
    e = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "weight")
    return e.unionByName(e.select(F.col("other").alias("node"), F.col("node").alias("other"), "weight"))


def neighbors(edges: DataFrame, node: str, most: int = 20) -> DataFrame:
    return both_ways(edges).where(F.col("node") == node).orderBy(F.desc("weight"), "other").limit(most)


def neighborhood(edges: DataFrame, mentions: DataFrame, node: str, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """The neighbours of an entity and the documents that mention it."""
    return neighbors(edges, node, most), mentions.where(F.col("entity_key") == node).select("document_id").distinct().orderBy("document_id")


def traverse(edges: DataFrame, node: str, depth: int = 2, most: int = 20) -> DataFrame:
    """level, node, other, weight of the edges met breadth first, ``most`` a node and level, to a depth of 1 to 3."""
    spark = edges.sparkSession
    ways = both_ways(edges)
    best = W.partitionBy("node").orderBy(F.desc("weight"), "other")
    front = spark.createDataFrame([(node,)], "node string")
    seen, out = front, None
    for level in range(1, min(max(depth, 1), 3) + 1):
        step = ways.join(front, "node", "left_semi").withColumn("r", F.row_number().over(best)).where(F.col("r") <= most)
        step = step.select(F.lit(level).alias("level"), "node", "other", "weight")
        out = step if out is None else out.unionByName(step)
        front = step.select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = seen.unionByName(front)
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """node and degree, the sum of the weights of its edges."""
    return both_ways(edges).groupBy("node").agg(F.sum("weight").alias("degree"))
