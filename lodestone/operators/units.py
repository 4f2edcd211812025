"""Empirical checks that values are in the unit they claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verify_range(df: DataFrame, keys: list[str], value: str, low: Column, high: Column, tolerance: float = 0.05) -> DataFrame:
    """Per key the share of values outside [low, high], and whether it is within the tolerance."""
    v = F.col(value)
    outside = ((v < low) | (v > high)).cast("double")
    return df.where(v.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(outside).alias("outside")).withColumn("passed", F.col("outside") <= tolerance)


def verify_skewness(df: DataFrame, keys: list[str], value: str, log_scale: bool = True, limit: float = 2.0) -> DataFrame:
    """Per key the population skewness; a value claimed to be logarithmic must not be much skewed.

    Fewer than three values, or no variance, are an error row.
    """
    v = F.col(value).cast("double")
    stats = df.where(v.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.skewness(v).alias("_g"), F.stddev_pop(v).alias("_sd"))
    error = (F.col("n") < 3) | (F.col("_sd") == 0)
    passed = F.abs(F.col("_g")) <= limit if log_scale else F.lit(True)
    return stats.select(*keys, "n", F.when(~error, F.col("_g")).alias("skewness"), F.when(~error, passed).alias("passed"), error.alias("error"))


def reference_gap(expected: Column, observed: Column) -> Column:
    """In decades where both are positive, else the plain difference."""
    e, o = expected.cast("double"), observed.cast("double")
    return F.when((e > 0) & (o > 0), F.abs(F.log10(e) - F.log10(o))).otherwise(F.abs(e - o))


def verify_references(df: DataFrame, expected: str, observed: str, tolerance: float = 1.0) -> DataFrame:
    """Whether every reference is near its expected value, and how many aren't."""
    gap = reference_gap(F.col(expected), F.col(observed))
    return df.agg(F.count(F.lit(1)).alias("n"), F.bool_and(gap <= tolerance).alias("passed"), F.count_if(gap > tolerance).alias("failures"))


def failed_references(df: DataFrame, name: str, expected: str, observed: str, tolerance: float = 1.0) -> DataFrame:
    """A row for each reference that isn't near its expected value."""
    gap = reference_gap(F.col(expected), F.col(observed))
    return df.where(gap > tolerance).select(name, F.col(expected).cast("double").alias("expected"), F.col(observed).cast("double").alias("observed"), gap.alias("gap"))


def reference_report(df: DataFrame, name: str, expected: str, observed: str, tolerance: float = 1.0) -> DataFrame:
    """The totals of verify_references beside each reference that failed; if none did, one row of totals alone."""
    totals = F.broadcast(verify_references(df, expected, observed, tolerance))
    return totals.join(failed_references(df, name, expected, observed, tolerance), F.lit(True), "left")
