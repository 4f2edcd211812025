"""Classification metrics as exact aggregates over distinct scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import stored


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """tp, fp, tn, fn and the rates from them; a rate with an empty denominator is null."""
    y, z = F.col(label) == 1, F.col(predicted) == 1
    counts = df.agg(F.count_if(y & z).alias("tp"), F.count_if(~y & z).alias("fp"), F.count_if(~y & ~z).alias("tn"), F.count_if(y & ~z).alias("fn"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    ratio = F.try_divide
    sensitivity, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return counts.select(
        "*",
        sensitivity.alias("sensitivity"), specificity.alias("specificity"), ratio(tp, tp + fp).alias("precision"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        ((sensitivity + specificity) / 2).alias("balanced_accuracy"),
        ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"),
        ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
    )


def score_counts(df: DataFrame, score: str, label: str, weight: Column | None = None) -> DataFrame:
    """Positives and negatives at each distinct score: the only rows the curves below are made of."""
    w = F.lit(1) if weight is None else weight
    one = F.col(label) == 1
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(F.when(one, w).otherwise(0)).alias("pos"), F.sum(F.when(one, 0).otherwise(w)).alias("neg"))


#: About so many rows of an order are put in order in one task; the ranges are at most so many.
RANGE_ROWS, MOST_RANGES = 100_000, 4_096


def ranged(df: DataFrame, order: str) -> DataFrame:
    """df, which has few rows for each order, written once and with _range: quantiles cut the orders into ranges of
    about RANGE_ROWS, ascending. Null orders come first."""
    df = stored(df, "orders")
    ranges = min(MOST_RANGES, -(-df.count() // RANGE_ROWS))
    at = F.when(F.col(order).isNull(), -1)
    if ranges <= 1:
        return df.withColumn("_range", at.otherwise(0))
    edges = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_edges"))
    at = at.otherwise(F.size(F.filter(F.coalesce("_edges", F.array().cast("array<double>")), lambda e: e < F.col(order))))
    return df.join(F.broadcast(edges)).withColumn("_range", at).drop("_edges")


def running_sums(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """df with before_v and all_v of each value: the sum over rows with a smaller order, and over all.

    df has one row for each order, and is narrow. Sums within a range, and over the ranges' own sums, make the
    running sum, so no task orders more than a range.
    """
    cut = ranged(df, order)
    over = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of the ranges' sums
    sums = cut.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values])
    offsets = sums.select("_range", *[F.coalesce(F.sum(v).over(over), F.lit(0)).alias(f"_o_{v}") for v in values], *[F.sum(v).over(Window.partitionBy()).alias(f"all_{v}") for v in values])
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = {f"before_{v}": F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}
    return cut.join(F.broadcast(offsets), "_range").withColumns(before).drop("_range", *[f"_o_{v}" for v in values])


def quantiles(df: DataFrame, value: str, fractions: list[float]) -> list[float | None]:
    """Exact quantiles of the non-null values, interpolated between neighbours: counts at distinct values are
    put in order in ranges, and of those the few around each quantile reach the driver. Null without values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    sums = running_sums(counts, "_v", ["_n"])
    place = lambda f: (F.col("all__n") - 1) * F.lit(float(f))
    holds = lambda at: (F.col("before__n") <= at) & (at < F.col("before__n") + F.col("_n"))
    names = [(f"_{k}_{i}", f, end) for i, f in enumerate(fractions) for k, end in (("low", F.floor), ("high", F.ceil))]
    row = sums.agg(F.max("all__n").alias("_all"), *[F.max(F.when(holds(end(place(f))), F.col("_v"))).alias(n) for n, f, end in names]).first()
    found = []
    for i, f in enumerate(fractions):
        low, high = row[f"_low_{i}"], row[f"_high_{i}"]
        at = (row["_all"] - 1) * f if row["_all"] else 0.0
        found.append(None if low is None else low + (high - low) * (at - int(at)))
    return found


def roc_auc(counts: DataFrame) -> DataFrame:
    """Mann-Whitney area with ties as a half; null with one class."""
    area = F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)
    return running_sums(counts, "score", ["neg"]).withColumn("_area", area).agg(F.try_divide(F.sum("_area"), F.sum("pos") * F.sum("neg")).alias("auc"))


def area_and_balance(counts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: auc as above, and balanced_accuracy of predicting 1 from the threshold on."""
    sums = running_sums(counts, "score", ["neg"]).withColumn("_area", F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    at = lambda c, right: F.try_divide(F.sum(F.when(right, F.col(c)).otherwise(0)), F.sum(c))
    hit, kept = at("pos", F.col("score") >= threshold), at("neg", F.col("score") < threshold)
    return sums.agg(F.try_divide(F.sum("_area"), F.sum("pos") * F.sum("neg")).alias("auc"), ((hit + kept) / 2).alias("balanced_accuracy"))


def average_precision(counts: DataFrame) -> DataFrame:
    """Sum over descending scores of the recall gained times the precision there."""
    pos, neg = (F.col(f"all_{c}") - F.col(f"before_{c}") for c in ("pos", "neg"))
    gained = running_sums(counts, "score", ["pos", "neg"]).withColumn("_gain", F.col("pos") * pos / (pos + neg))
    return gained.agg(F.try_divide(F.sum("_gain"), F.sum("pos")).alias("average_precision"))


def brier(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def _range_areas(replicates: int):
    """Of a range's cells: each replicate's positives, negatives, and area of its own positives above its own
    negatives. A cell's weights come from a generator seeded by the cell."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        pos, neg, area = np.zeros((3, replicates))
        for _, same in cells.sort_values("score", kind="stable").groupby("score", sort=False, dropna=False):
            own = np.zeros((2, replicates))
            for one, n, seed in zip(same["one"], same["n"], same["seed"]):
                own[int(one)] += np.random.Generator(np.random.Philox(key=int(seed) & (2**64 - 1))).poisson(n, replicates)
            area += own[1] * (neg + own[0] / 2)
            neg, pos = neg + own[0], pos + own[1]
        at = int(cells["_range"].iloc[0])
        return pd.DataFrame({"_range": at, "replicate": np.arange(replicates), "pos": pos, "neg": neg, "area": area})

    return run


def bootstrap_auc(df: DataFrame, score: str, label: str, replicates: int = 1_000, seed: int = 42) -> DataFrame:
    """2.5 and 97.5 percentiles of the area over Poisson resamples, skipping those with one class.

    Rows of one score and label are one cell: the weight of a cell of n rows in a replicate is a Poisson number
    of mean n, as a sum of the rows' own would be. Cells are put in order once, in ranges; a range gives three
    numbers for each replicate, whatever its rows, and the ranges before it tell how many negatives lie below.
    Reruns agree. Null scores lie below all others, null labels are negatives.
    """
    one = F.coalesce(F.col(label) == 1, F.lit(False))
    cells = df.groupBy(F.col(score).cast("double").alias("score"), one.alias("one")).agg(F.count(F.lit(1)).alias("n"))
    cells = ranged(cells.withColumn("seed", F.xxhash64(F.lit(seed), "score", "one")), "score")
    parts = cells.groupBy("_range").applyInPandas(_range_areas(replicates), "_range int, replicate int, pos double, neg double, area double")
    below = Window.partitionBy("replicate").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of the ranges
    whole = parts.withColumn("area", F.col("area") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    areas = whole.groupBy("replicate").agg(F.try_divide(F.sum("area"), F.sum("pos") * F.sum("neg")).alias("auc"))
    return areas.where("auc is not null").agg(  # as many rows as replicates
        F.count(F.lit(1)).alias("replicates"), F.percentile("auc", F.lit(0.025)).alias("low"), F.percentile("auc", F.lit(0.975)).alias("high")
    )


def worst_groups(df: DataFrame, key: str, wrong: Column, least: int = 3, top: int = 10) -> DataFrame:
    """Groups of at least `least` rows by error rate; ties by size, then key."""
    rates = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(wrong.cast("double")).alias("error_rate")).where(F.col("n") >= least)
    return rates.orderBy(F.desc("error_rate"), F.desc("n"), key).limit(top)


def champion(results: DataFrame, name: str, score: str, order: str) -> DataFrame:
    """The name with the highest score; the first in order among equals."""
    return results.agg(F.max_by(name, F.struct(F.col(score), -F.col(order))).alias("champion"), F.max(score).alias("score"))


def fraction_of(df: DataFrame, keys: list[str], right: Column) -> DataFrame:
    """Rows and accuracy by keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"))
