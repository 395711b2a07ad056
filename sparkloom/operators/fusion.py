"""Rank fusion, boosts, reranking and diversity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as X

PHRASE, ENTITY, SECTION, ENTITY_WEIGHT = 0.08, 0.03, 0.02, 0.8


def depth(k: int) -> int:
    return min(max(6 * k, 24), 200)


def rrf(channels: list[tuple[str, float, DataFrame]], k: int = 60) -> DataFrame:
    """query_id, id, score and matched_by of ranked channels (query_id, id, rank, value): a full outer merge as union and aggregation."""
    rows = None
    for name, weight, t in channels:
        r = t.select("query_id", "id", F.lit(name).alias("source"), "rank", F.col("value").cast("double").alias("value"), F.lit(float(weight)).alias("w"))
        rows = r if rows is None else rows.unionByName(r)
    return rows.groupBy("query_id", "id").agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"), F.sort_array(F.collect_list(F.struct("source", "rank", "value"))).alias("matched_by"))


def boosts(score: Column, text: Column, section: Column, authority: Column, query: Column, known: Column) -> Column:
    """The score by authority, and more for the whole query, a known entity, and words of the query in the section's title."""
    low = F.lower(text)
    phrase = F.when((F.trim(query) != "") & low.contains(F.lower(query)), PHRASE).otherwise(0.0)
    entity = F.when(F.exists(known, lambda n: low.contains(F.lower(n))), ENTITY).otherwise(0.0)
    shared = F.size(F.array_intersect(F.array_distinct(X.tokens(F.coalesce(section, F.lit("")))), F.array_distinct(X.tokens(query))))
    return score * F.greatest(authority, F.lit(0.1)) + phrase + entity + SECTION * shared


def rerank(hits: DataFrame, top: int = 24) -> DataFrame:
    """query_id, id, score, rank after blending the first ``top`` scores with lexical overlap.

    hits: query_id, id, score, text, query. Overlap is the share of the query's distinct tokens that a text has, by
    the square root of ln(distinct tokens + 32), scaled to 0..1 within the window; rows behind the window keep their scores and place.
    """
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    asked = F.array_distinct(X.tokens(F.col("query")))
    have = F.array_distinct(X.tokens(F.col("text")))
    cover = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, have)) / F.size(asked)).otherwise(0.0) / F.sqrt(F.log(F.size(have) + 32))
    rows = hits.withColumn("rn", F.row_number().over(order)).withColumn("inside", F.col("rn") <= top).withColumn("raw", F.when(F.col("inside"), cover))
    whole = W.partitionBy("query_id")
    low, high = F.min("raw").over(whole), F.max("raw").over(whole)
    scaled = (F.col("raw") - low) / F.greatest(high - low, F.lit(1.1920929e-07))
    rows = rows.withColumn("blended", F.when(F.col("inside"), 0.5 * F.col("score") + 0.5 * scaled).otherwise(F.col("score")))
    final = W.partitionBy("query_id").orderBy(F.desc("inside"), F.desc(F.round("blended", 12)), "id")
    return rows.withColumn("rank", F.row_number().over(final)).select("query_id", "id", F.col("blended").alias("score"), "rank")


def mmr(ids: list[int], scores: list[float], vectors: dict[int, np.ndarray], k: int, weight: float = 0.7, most: int = 64) -> list[int]:
    """The k positions that greedily maximise weight * score - (1 - weight) * largest similarity to those chosen; at most 200 rows."""
    if k >= len(ids) or weight >= 0.999:
        return list(range(min(k, len(ids))))
    units = {}
    for p, i in enumerate(ids[:most]):
        v = vectors.get(i)
        if v is not None and (n := float(np.sqrt(v @ v))) > 0:
            units[p] = v / n
    left, out = list(range(len(ids))), []
    while left and len(out) < k:
        def value(p: int) -> float:
            near = max((float(units[p] @ units[o]) for o in out if p in units and o in units and len(units[p]) == len(units[o])), default=0.0)
            return weight * scores[p] - (1 - weight) * max(near, 0.0)

        best = max(left, key=lambda p: (value(p), -p))
        out.append(best)
        left.remove(best)
    return out
