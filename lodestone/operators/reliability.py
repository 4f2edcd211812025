"""Applicability-domain verdicts, conformal prediction sets, calibration error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.metrics import quantiles, running_sums

IN, BORDER, OUT, UNKNOWN = "in_domain", "borderline", "out_of_domain", "undeterminable"
OUT_SIMILARITY, BORDER_SIMILARITY = 0.4, 0.6
#: One minus the nominal confidence as a double: a p-value of a tenth is above it.
SIGNIFICANCE = 1.0 - 0.9


def _verdict(similarity: Column, signals: list[Column], known: Column) -> Column:
    n = sum((s.cast("int") for s in signals), F.lit(0))
    return (
        F.when(~known, UNKNOWN).when(similarity < OUT_SIMILARITY, OUT).when(n >= 2, OUT).when(n == 1, BORDER).otherwise(IN)
    )


def ad_verdict(similarity: Column, distance: Column, distance_limit: Column, scaffold_seen: Column) -> Column:
    """Far from all references is out; else two or more of (dissimilar, distant, unseen scaffold) are
    out and one is borderline. A null scaffold flag counts as unseen."""
    signals = [similarity < BORDER_SIMILARITY, distance > distance_limit, ~F.coalesce(scaffold_seen, F.lit(False))]
    return _verdict(similarity, signals, similarity.isNotNull() & distance.isNotNull() & distance_limit.isNotNull())


def ad_verdict_without_scaffold(similarity: Column, distance: Column, distance_limit: Column) -> Column:
    signals = [similarity < BORDER_SIMILARITY, distance > distance_limit]
    return _verdict(similarity, signals, similarity.isNotNull() & distance.isNotNull() & distance_limit.isNotNull())


def verdict_with_elements(verdict: Column, unseen: Column) -> Column:
    """An element that the training rows never had forces a row out of the domain, whatever its signals."""
    return F.when(F.size(F.coalesce(unseen, F.array().cast("array<string>"))) > 0, OUT).otherwise(verdict)


def ad_rationale(similarity: Column, distance: Column, distance_limit: Column, scaffold_seen: Column) -> Column:
    """The signals that count against the row, in words."""
    return F.array_join(
        F.array_compact(
            F.array(
                F.when(similarity < OUT_SIMILARITY, "no similar reference"),
                F.when((similarity >= OUT_SIMILARITY) & (similarity < BORDER_SIMILARITY), "few similar references"),
                F.when(distance > distance_limit, "distant descriptors"),
                F.when(~F.coalesce(scaffold_seen, F.lit(False)), "unseen scaffold"),
            )
        ),
        "; ",
    )


def reliability_rating(verdict: Column, singleton: Column) -> Column:
    """Low out of the domain or where it can't be told, Moderate on its border, else by the prediction set."""
    return F.when(verdict == BORDER, "Moderate").when((verdict == IN) & singleton, "High").when(verdict == IN, "Moderate").otherwise("Low")


def nonconformity(p: Column, label: Column) -> Column:
    """1 - p(true class)."""
    return F.when(label == 1, 1 - p).otherwise(p)


def conformal_p(queries: DataFrame, alphas: DataFrame, query_alpha: str, alpha: str = "alpha") -> DataFrame:
    """queries with p_value = (calibration scores >= the query's + 1) / (all + 1).

    Both sides' distinct scores are put in order once, within ranges; no query meets a calibration row.
    """
    counted = alphas.groupBy(F.col(alpha).alias("_a")).agg(F.count(F.lit(1)).alias("_n"))
    asked = queries.select(F.col(query_alpha).alias("_a")).distinct().withColumn("_n", F.lit(0).cast("long"))
    points = counted.unionByName(asked).groupBy("_a").agg(F.sum("_n").alias("_n"))
    at_least = running_sums(points, "_a", ["_n"]).select("_a", (F.col("all__n") - F.col("before__n")).alias("_ge"), F.col("all__n").alias("_all"))
    return queries.join(at_least, queries[query_alpha] == at_least._a, "left").withColumn("p_value", (F.col("_ge") + 1) / (F.col("_all") + 1)).drop("_a", "_ge", "_all")


def prediction_set(p_one: Column, p_zero: Column, significance: float = SIGNIFICANCE) -> Column:
    return F.array_compact(F.array(F.when(p_one > significance, 1), F.when(p_zero > significance, 0)))


def set_kind(prediction: Column) -> Column:
    return F.when(F.size(prediction) == 1, "singleton").when(F.size(prediction) == 2, "both").otherwise("empty")


def coverage(df: DataFrame, prediction: str, label: str, predicted: str, target: float = 0.9, tolerance: float = 0.05) -> DataFrame:
    """Coverage, sizes of sets, accuracy on singletons and on the others."""
    right = (F.col(predicted) == F.col(label)).cast("double")
    single = F.size(prediction) == 1
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.array_contains(prediction, F.col(label)).cast("double")).alias("coverage"),
        F.count_if(single).alias("singletons"),
        F.count_if(F.size(prediction) == 2).alias("both"),
        F.count_if(F.size(prediction) == 0).alias("empty"),
        F.avg(F.when(single, right)).alias("accuracy_singleton"),
        F.avg(F.when(~single, right)).alias("accuracy_uncertain"),
    ).withColumn("covers", F.col("coverage") >= target - tolerance)


#: The nine inner edges of ten equal bins, as doubles that repeated addition of a tenth doesn't give.
EDGES = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)


def bin_of(p: Column) -> Column:
    """Bin 0-9 of a probability; bins hold their lower edge, the last both."""
    return sum(((p >= e).cast("int") for e in EDGES), F.lit(0))


def calibration_bins(df: DataFrame, p: str, label: str) -> DataFrame:
    return df.groupBy(bin_of(F.col(p)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(label).cast("double")).alias("frequency")
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error: the bins' gaps weighted by their rows."""
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("frequency"))) / F.sum("n")).alias("ece"))


def reliability_curve(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Mean prediction and frequency between quantiles of the predictions; a row on an edge falls below it."""
    edges = [e for e in quantiles(df, p, [i / bins for i in range(1, bins)]) if e is not None]
    at = sum(((F.col(p) > e).cast("int") for e in edges), F.lit(0))
    return df.groupBy(at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(label).cast("double")).alias("frequency")
    )
