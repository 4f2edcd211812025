"""Comparison of two releases of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.metrics import running_sums


def kolmogorov_smirnov(old: DataFrame, new: DataFrame, value: str) -> DataFrame:
    """Largest distance between the two distributions of non-null values.

    Only counts at distinct values are put in order, never the rows.
    """
    count = lambda df, name: df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias(name))
    both = count(old, "a").join(count(new, "b"), "v", "full").na.fill(0, ["a", "b"])
    sums = running_sums(both, "v", ["a", "b"])
    share = lambda c: F.try_divide(F.col(f"before_{c}") + F.col(c), F.col(f"all_{c}"))
    return sums.select(F.abs(share("a") - share("b")).alias("d")).agg(F.max("d").alias("ks"))


def release_summary(old: DataFrame, new: DataFrame, value: str, label: str) -> DataFrame:
    """Rows, null rate and positive rate of each release."""
    of = lambda df, name: df.agg(
        F.lit(name).alias("release"), F.count(F.lit(1)).alias("n"), F.avg(F.col(value).isNull().cast("double")).alias("null_rate"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
    )
    return of(old, "old").unionByName(of(new, "new"))
