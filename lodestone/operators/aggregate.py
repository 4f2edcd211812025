"""Aggregation that reports disagreement instead of averaging it away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.metrics import quantiles

#: A spread above this (decades for positive values) marks a group as discordant.
DISCORDANCE = 1.0


def _bool(flag: bool | Column) -> Column:
    return F.lit(flag) if isinstance(flag, bool) else flag


def aggregate_continuous(
    df: DataFrame, keys: list[str], value: str, potency: bool = True, threshold: float = DISCORDANCE
) -> DataFrame:
    """Per key: n, value, method, spread, discordant, error.

    One value is taken as it is. Several give their geometric mean (potency) or exact median; the
    spread is log10(max/min) where all are positive, else max - min, and is compared unrounded and
    strictly. Potencies that aren't all positive are an error row with null value and flag.
    """
    v = F.col(value).cast("double")
    stats = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(v).alias("_lo"),
        F.max(v).alias("_hi"),
        F.avg(F.log10(F.when(v > 0, v))).alias("_log"),
        *([] if potency else [F.median(v).alias("_median")]),
    )
    single, positive = F.col("n") == 1, F.col("_lo") > 0
    error = ~single & ~positive if potency else F.lit(False)
    spread = F.when(single, 0.0).when(positive, F.log10(F.col("_hi") / F.col("_lo"))).otherwise(F.col("_hi") - F.col("_lo"))
    centre = F.pow(F.lit(10.0), "_log") if potency else F.col("_median")
    return stats.select(
        *keys,
        "n",
        F.when(single, F.col("_lo")).when(~error, centre).alias("value"),
        F.when(single, "single_value").otherwise("geometric_mean" if potency else "median").alias("method"),
        F.when(~error, spread).alias("spread"),
        F.when(~error, ~single & (spread > threshold)).alias("discordant"),
        error.alias("error"),
    )


def aggregate_binary(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Per key the majority of boolean labels: 1.0 or 0.0; a tie is 0.5 and discordant."""
    stats = df.where(F.col(label).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label)).alias("n_true")
    )
    tie = 2 * F.col("n_true") == F.col("n")
    return stats.select(
        *keys, "n", "n_true",
        F.when(tie, 0.5).when(2 * F.col("n_true") > F.col("n"), 1.0).otherwise(0.0).alias("value"),
        F.when(F.col("n") == 1, "single_value").otherwise("majority_vote").alias("method"),
        tie.alias("discordant"),
    )


def carried_sets(df: DataFrame, keys: list[str], columns: list[str], separator: str = ";") -> DataFrame:
    """Per key each column's distinct non-null values, sorted and joined, and how many there are."""
    outs = []
    for c in columns:
        values = F.array_sort(F.collect_set(F.col(c).cast("string")))
        outs += [F.array_join(values, separator).alias(f"{c}_set"), F.size(values).alias(f"n_{c}")]
    return df.groupBy(*keys).agg(*outs)


def aggregate_by_policy(df: DataFrame, keys: list[str], value: str, confidence: str, as_of: str, tier: str, policy: str) -> DataFrame:
    """Per key the most confident and the most recent value, and the licence tiers consumed.

    Ties go to the larger value, so the choice doesn't depend on the partitioning.
    """
    return df.groupBy(*keys).agg(
        F.max(F.struct(F.col(confidence), F.col(value)))[value].alias("max_confidence"),
        F.max(F.struct(F.col(as_of), F.col(value)))[value].alias("most_recent"),
        F.array_join(F.array_sort(F.collect_set(tier)), ",").alias("license_tiers_consumed"),
    ).withColumn("policy_version", F.lit(policy))


def label_at(value: Column, threshold: float) -> Column:
    """1 where value <= threshold."""
    return F.when(value <= threshold, 1).otherwise(0)


def relabel(df: DataFrame, value: str, thresholds: dict[str, float]) -> DataFrame:
    """One row for each input row and threshold, with its label."""
    table = F.array(*[F.struct(F.lit(k).alias("threshold"), F.lit(v).alias("at")) for k, v in thresholds.items()])
    return df.withColumn("_t", F.explode(table)).select("*", "_t.threshold", label_at(F.col(value), F.col("_t.at")).alias("label")).drop("_t")


def with_fraction(counts: DataFrame, count: str = "n") -> DataFrame:
    """Adds each row's share of all; counts has one row for each category."""
    total = counts.agg(F.sum(count).alias("_all"))  # one row
    return counts.join(F.broadcast(total)).withColumn("fraction", F.col(count) / F.col("_all")).drop("_all")


def paradigm_ratio(df: DataFrame, key: str, category: str, value: str, first: str, second: str) -> DataFrame:
    """Of keys measured under both categories: log10 ratio of their geometric means, summarised."""
    of = lambda c: F.avg(F.when(F.col(category) == c, F.log10(F.when(F.col(value) > 0, F.col(value)))))
    ratio = df.groupBy(key).agg((of(first) - of(second)).alias("r")).where("r is not null")
    return ratio.agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.lit(quantiles(ratio, "r", [0.5])[0]).cast("double").alias("median"), F.stddev_samp("r").alias("sd"),
        F.avg((F.abs("r") > 1).cast("double")).alias("over_1"), F.avg((F.abs("r") > 0.5).cast("double")).alias("over_half"),
    )


def mixed_categories(df: DataFrame, key: str, category: str, value: str, unknown: str = "unknown", threshold: float = DISCORDANCE) -> DataFrame:
    """Per key: n_categories (without unknown), whether mixed, and whether its values are discordant."""
    spread = F.log10(F.max(value) / F.min(value))
    return df.where(F.col(value) > 0).groupBy(key).agg(
        F.count_distinct(F.when(F.col(category) != unknown, F.col(category))).alias("n_categories"), spread.alias("_spread")
    ).select(key, "n_categories", (F.col("n_categories") > 1).alias("mixed"), (F.col("_spread") > threshold).alias("discordant"))


def disproportionality(df: DataFrame, item: str, event: str, count: str) -> DataFrame:
    """Reporting ratios of each (item, event) from its 2x2 table: prr, ror and the ror's 95 % limits."""
    cell = df.groupBy(item, event).agg(F.sum(count).alias("a"))
    total = lambda name, *keys: cell.groupBy(*keys).agg(F.sum("a").alias(name))
    # The sum of all is one row.
    sums = cell.join(total("_item", item), item).join(total("_event", event), event).join(F.broadcast(total("_all")))
    a, item_n, event_n, all_n = (F.col(c) for c in ("a", "_item", "_event", "_all"))
    table = sums.withColumns({"b": item_n - a, "c": event_n - a, "d": all_n - item_n - event_n + a}).where("b > 0 and c > 0 and d > 0")
    b, c, d = F.col("b"), F.col("c"), F.col("d")
    se = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    log_ror = F.log((a * d) / (b * c))
    return table.select(
        item, event, "a", (a / (a + b) / (c / (c + d))).alias("prr"), ((a * d) / (b * c)).alias("ror"),
        F.exp(log_ror - 1.96 * se).alias("ror_low"), F.exp(log_ror + 1.96 * se).alias("ror_high"),
    )
