"""Conflicts between claims: numbers that differ, and assertions that others negate.

A number is compared with the 39 claims before it of the same subject and
predicate, newest first, and keeps its four latest conflicts; the claim before
is ``claim_a``. Both limits are those of the feature, so a metric that a third
of all rows state costs 40 comparisons a row and no pair table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as X

DELTA, BEFORE, KEPT = 0.05, 39, 4


def numeric_conflicts(claims: DataFrame) -> DataFrame:
    """claim_a (older), claim_b, keys, delta and kind, from the last BEFORE numeric claims of the same keys."""
    value = X.first_number(F.col("object"))
    numbers = claims.where(F.col("object").rlike("[0-9]")).withColumn("value", value).where(F.col("value").isNotNull())
    order = W.partitionBy("subject_key", "predicate_key").orderBy("claim_id")
    earlier = F.collect_list(F.struct("claim_id", "value", F.substring("valid_from", 1, 4).alias("year"))).over(order.rowsBetween(-BEFORE, -1))
    rows = numbers.withColumn("earlier", earlier).where(~F.col("negated") & (F.col("value") > 0))
    pairs = rows.select("subject_key", "predicate_key", F.col("claim_id").alias("claim_b"), F.col("value").alias("vb"), F.substring("valid_from", 1, 4).alias("yb"), F.explode(F.reverse("earlier")).alias("e"))
    pairs = pairs.where(F.col("e.value") > 0).withColumn("delta", F.abs(F.col("vb") - F.col("e.value")) / F.greatest("vb", F.col("e.value"))).where(F.col("delta") > DELTA)
    newest = W.partitionBy("claim_b").orderBy(F.desc("e.claim_id"))
    kept = pairs.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= KEPT)
    kind = F.when(F.col("yb") == F.col("e.year"), "same-period-disagreement").when(F.col("yb") != F.col("e.year"), "cross-period").otherwise("undated-disagreement")
    share = F.format_string("%.0f%%", F.col("delta") * 100)
    why = (
        F.when(kind == "same-period-disagreement", F.concat(F.lit("values for "), "yb", F.lit(" are "), share, F.lit(" apart")))
        .when(kind == "cross-period", F.concat(F.lit("values for "), "yb", F.lit(" and "), "e.year", F.lit(" are "), share, F.lit(" apart")))
        .otherwise(F.concat(F.lit("values without periods are "), share, F.lit(" apart")))
    )
    return kept.select(F.col("e.claim_id").alias("claim_a"), "claim_b", "subject_key", "predicate_key", "delta", kind.alias("kind"), why.alias("explanation"))


def negation_conflicts(claims: DataFrame) -> DataFrame:
    """Negated claims against every earlier claim of the same keys that isn't negative."""
    no = claims.where("negated").select("subject_key", "predicate_key", F.col("claim_id").alias("claim_b"))
    yes = claims.where(~X.negative(F.col("sentence")) & (F.col("object") != "")).select("subject_key", "predicate_key", F.col("claim_id").alias("claim_a"))
    pairs = no.join(yes, ["subject_key", "predicate_key"]).where("claim_a < claim_b")
    return pairs.select("claim_a", "claim_b", "subject_key", "predicate_key", F.lit(1.0).alias("delta"), F.lit("negation-conflict").alias("kind"), F.lit("one claim states what another denies").alias("explanation"))


def conflicts(claims: DataFrame) -> DataFrame:
    """Both kinds, one row a pair."""
    return numeric_conflicts(claims).unionByName(negation_conflicts(claims)).dropDuplicates(["claim_a", "claim_b"])


def latest(found: DataFrame, most: int) -> DataFrame:
    return found.orderBy(F.desc("claim_b"), F.desc("claim_a")).limit(most)
