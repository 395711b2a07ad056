"""Entity resolution, co-occurrence and merges.

Every automatic link (same key, same surface, similar key of the same type) stays
among keys with the same first character, so the order-dependent resolution runs
as one group for each of these, over distinct (key, surface, type) triples in the
order of their first appearance, not over mentions: a frequent entity is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..text import jaro_winkler

SIMILAR, CANDIDATES = 0.93, 256


def _resolve(rows: Iterator[tuple[str, str, str, int]]) -> list[tuple[str, str, str, str, float, int]]:
    """(key, surface, type, entity key, confidence, seq) of triples in order; an entity is named by its first key."""
    owner: dict[str, str] = {}  # keys, and surfaces in lower case, to the entity's key
    alias: dict[str, str] = {}
    kinds: dict[str, list[str]] = {}
    out = []
    for key, surface, kind, seq in rows:
        low = surface.lower()
        entity, sure = None, 1.0
        if key in owner:
            entity = owner[key]
        elif key in alias:
            entity = alias[key]
        elif low in alias:
            entity, sure = alias[low], 0.95
        elif len(key.encode()) >= 3:
            best = 0.0
            for other in kinds.get(kind, [])[:CANDIDATES]:
                s = jaro_winkler(key, other)
                if s >= SIMILAR and s > best:
                    entity, best = other, s
            if entity is not None:
                sure = best * 0.9
        if entity is None:
            owner[key] = entity = key
            kinds.setdefault(kind, []).append(key)
        alias.setdefault(low, entity)
        out.append((key, surface, kind, entity, sure, seq))
    return out


def resolve(mentions: DataFrame) -> DataFrame:
    """The mentions, each with its entity's key and a confidence times that of the resolution.

    Seq is (chunk, ordinal) packed in one number, so that the smallest one of a triple comes by aggregation.
    """
    seq = F.struct("chunk_id", "ordinal")
    triples = mentions.groupBy("key", "surface", "entity_type").agg(F.min(seq).alias("seq"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chunk_id", "ordinal", "surface", "entity_type"], kind="stable")
        rows = _resolve(zip(pdf["key"], pdf["surface"], pdf["entity_type"], pdf["chunk_id"]))
        return pd.DataFrame([(k, s, t, e, c) for k, s, t, e, c, _ in rows], columns=["key", "surface", "entity_type", "entity_key", "resolution"])

    blocks = triples.select("key", "surface", "entity_type", "seq.chunk_id", "seq.ordinal", F.substring("key", 1, 1).alias("block"))
    found = blocks.groupBy("block").applyInPandas(lambda pdf: block(pdf), "key string, surface string, entity_type string, entity_key string, resolution double")
    return mentions.join(found, ["key", "surface", "entity_type"]).withColumn("confidence", F.col("confidence") * F.col("resolution")).drop("resolution")


def merged(mentions: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """Mentions after merges (survivor, merged) of entity keys, applied in their order; chains are followed."""
    to: dict[str, str] = {}
    for survivor, gone in merges:
        for k, v in list(to.items()):
            if v == gone:
                to[k] = survivor
        to[gone] = survivor
    if not to:
        return mentions
    table = mentions.sparkSession.createDataFrame([(k, v) for k, v in to.items()], "entity_key string, survivor string")  # the user's own list
    return mentions.join(F.broadcast(table), "entity_key", "left").withColumn("entity_key", F.coalesce("survivor", "entity_key")).drop("survivor")


def entity_table(resolved: DataFrame) -> DataFrame:
    """entity_key, display_name (the first surface), entity_type, mention_count (distinct chunks), first and last document."""
    order = F.struct("chunk_id", "ordinal")
    return resolved.groupBy("entity_key").agg(
        F.min_by("surface", order).alias("display_name"),
        F.min_by("entity_type", order).alias("entity_type"),
        F.countDistinct("chunk_id").alias("mention_count"),
        F.min("document_id").alias("first_document"),
        F.max("document_id").alias("last_document"),
        F.sort_array(F.collect_set("surface")).alias("aliases"),
    )


def cooccurrence(resolved: DataFrame) -> DataFrame:
    """source < target, weight (chunks that mention both), first and last document."""
    at = resolved.select("chunk_id", "document_id", "entity_key").distinct()
    a, b = at.alias("a"), at.alias("b")
    pairs = a.join(b, F.expr("a.chunk_id = b.chunk_id and a.entity_key < b.entity_key"))
    return pairs.groupBy(F.col("a.entity_key").alias("source"), F.col("b.entity_key").alias("target")).agg(F.count("*").alias("weight"), F.min("a.document_id").alias("first_document"), F.max("a.document_id").alias("last_document"))


def by_name(entities: DataFrame, fragment: str, most: int = 10) -> DataFrame:
    """Entities whose name holds the fragment, whatever its case, most mentioned first."""
    return entities.where(F.lower("display_name").contains(fragment.lower())).orderBy(F.desc("mention_count"), "entity_key").limit(most)
