"""Content-hash splits and leakage audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = 10
#: Groups by role: 0-6 train, 7 calibration, 8 validation, 9 test.
CALIBRATION, VALIDATION, TEST = 7, 8, 9


def split_group(key: Column, salt: str) -> Column:
    """SHA-256 of key and salt, as an integer modulo 10, from its hex digits.

    Every power of 16 is 6 modulo 10, so the digits' sum does: the last once, the others six times.
    """
    digest = F.sha2(F.concat(key.cast("string"), F.lit("||" + salt)), 256)
    digit = lambda i: F.conv(F.substr(digest, F.lit(i), F.lit(1)), 16, 10).cast("int")
    others = F.lit(0)
    for i in range(1, 64):
        others = others + digit(i)
    return F.pmod(digit(64) + 6 * others, F.lit(GROUPS))


def scaffold_key(scaffold: Column, own: Column) -> Column:
    """The scaffold, or for those without one the structure itself."""
    return F.coalesce(F.nullif(scaffold, F.lit("")), own)


def role(group: Column) -> Column:
    return (
        F.when(group < CALIBRATION, "train").when(group == CALIBRATION, "calibration").when(group == VALIDATION, "validation").otherwise("test")
    )


def spanning_keys(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that occur in more than one group: a leak."""
    return df.groupBy(key).agg(F.count_distinct(group).alias("n_groups"), F.count(F.lit(1)).alias("n")).where("n_groups > 1")


def split_balance(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows and label mean of each group."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("mean"))


def balance_summary(balance: DataFrame) -> DataFrame:
    return balance.agg(F.min("mean").alias("min_mean"), F.max("mean").alias("max_mean"), F.stddev_pop("mean").alias("sd_mean"), F.sum("n").alias("n"))


def leakage_gate(checks: DataFrame, gating: list[str]) -> DataFrame:
    """checks: check, status. passed holds if every gating check is there and is PASS; REVIEW of the others
    is counted."""
    gates = F.col("check").isin(*gating)
    return checks.agg(
        ((F.count_distinct(F.when(gates & (F.col("status") == "PASS"), F.col("check"))) == len(set(gating))) & (F.count_if(gates & ~F.col("status").eqNullSafe("PASS")) == 0)).alias("passed"),
        F.count_if(~gates & (F.col("status") == "REVIEW")).alias("reviews"),
    )


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a whose keys occur in b."""
    return a.join(b.select(*keys).distinct(), keys, "left_semi")


def disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a whose keys don't occur in b; a null key occurs nowhere, so its row stays."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def difference(a: DataFrame, b: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one table that the other lacks, repeats counted, without the ignored columns."""
    a, b = a.drop(*ignore), b.drop(*ignore)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
