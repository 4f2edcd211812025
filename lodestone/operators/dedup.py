"""Duplicate groups with a deterministic representative, keep-first, and value resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Licence tiers from least to most restrictive; unknown ones rank last.
TIERS = ("green", "amber", "red", "black")
UNKNOWN_TIER = 99


def tier_rank(tier: Column) -> Column:
    rank = F.lit(UNKNOWN_TIER)
    for i, name in reversed(list(enumerate(TIERS))):
        rank = F.when(tier == name, i).otherwise(rank)
    return rank


def duplicate_groups(df: DataFrame, key: str, record: str, seq: str, salts: int = 32) -> DataFrame:
    """Records of the keys of two records or more: key, n, representative (the first record by seq), record.

    A key's number and representative are aggregated before they meet its records, and once more by salt,
    so a key that holds a third of all records is in `salts` tasks and in no array. Records without a
    key are none's duplicates.
    """
    salted = df.where(F.col(key).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64(seq, record), F.lit(salts)))
    groups = salted.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by(record, F.struct(seq, record)).alias("representative")).where("n > 1")
    placed = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(placed, [key, "_salt"]).select(key, "n", "representative", record)


def measurement_duplicates(
    df: DataFrame, entity: str, target: str, reference: str, tier: str, confidence: str, seq: str, record: str
) -> DataFrame:
    """Groups of two or more by (entity, target, reference), where an empty reference is none.

    Records with a reference never meet those without. The representative has the least restrictive
    tier, then the highest confidence, then the first seq.
    """
    keyed = df.withColumn("_ref", F.nullif(F.col(reference), F.lit("")))
    best = F.min_by(record, F.struct(tier_rank(F.col(tier)), -F.col(confidence), F.col(seq)))
    return (
        keyed.groupBy(entity, target, F.col("_ref").alias("reference"))
        .agg(F.count(F.lit(1)).alias("n"), best.alias("representative"))
        .where("n > 1")
        .withColumn("criterion", F.when(F.col("reference").isNull(), "without_reference").otherwise("with_reference"))
    )


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; the order should be total."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def resolve(candidates: DataFrame, keys: list[str], precedence: str, domain: str, score: str, as_of: str, tie: str) -> DataFrame:
    """One value for each key: by precedence, in the model's domain before out of it, by score with
    null last, most recent, then by tie."""
    outside = F.col(domain).eqNullSafe(F.lit("out_of_domain"))
    return keep_first(candidates, keys, F.col(precedence), outside, F.desc_nulls_last(score), F.desc(as_of), F.col(tie))


def nearest_rows(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def newest_of_each(df: DataFrame, key: str, as_of: str, limit: int = 50) -> DataFrame:
    """History without repeats: the newest row of each key, the newest `limit` of them."""
    return keep_first(df, [key], F.desc(as_of)).orderBy(F.desc(as_of), key).limit(limit)
