"""Profiles and report counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.aggregate import with_fraction
from lodestone.operators.metrics import quantiles


def profile(df: DataFrame, key: str, value: str, suspicious: float = 1e9, most_impossible: float = 0.05) -> DataFrame:
    """One row: size, distinct and repeated keys, missing, range, impossible and suspicious values, verdict."""
    v = F.col(value)
    impossible = v.isNull() | (v <= 0)
    counts = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_keys"), F.count_if(v.isNull()).alias("missing"),
        F.min(v).alias("min"), F.lit(quantiles(df, value, [0.5])[0]).cast("double").alias("median"), F.max(v).alias("max"),
        F.count_if(impossible).alias("impossible"), F.count_if(v > suspicious).alias("suspicious"),
    )
    return counts.withColumn("repeated", F.col("n") - F.col("n_keys")).withColumn(
        "verdict", F.when((F.col("n") == 0) | (F.try_divide(F.col("impossible"), F.col("n")) > most_impossible), "STOP").otherwise("PROCEED")
    )


def histogram(df: DataFrame, category: str) -> DataFrame:
    return with_fraction(df.groupBy(category).agg(F.count(F.lit(1)).alias("n")))


def exploded_counts(df: DataFrame, joined: str, out: str, separator: str = ";") -> DataFrame:
    """How often each part of a joined column occurs, empty parts aside."""
    return df.select(F.explode(F.split(joined, separator)).alias(out)).where(F.col(out) != "").groupBy(out).agg(F.count(F.lit(1)).alias("n"))


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("positive"), F.avg(F.col(label).cast("double")).alias("fraction"))


def both_classes(df: DataFrame, scaffold: str, label: str) -> DataFrame:
    """Distinct scaffolds of each class, and how many have both."""
    per = df.groupBy(scaffold).agg(F.max((F.col(label) == 1).cast("int")).alias("_p"), F.max((F.col(label) == 0).cast("int")).alias("_n"))
    return per.agg(F.sum("_p").alias("positive"), F.sum("_n").alias("negative"), F.count_if((F.col("_p") == 1) & (F.col("_n") == 1)).alias("both"))


def run_report(df: DataFrame, error: str, flags: str, names: list[str]) -> DataFrame:
    """Counters of a pipeline run: attempted, processed, quarantined, and each flag's rows."""
    return df.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(F.col(error).isNull()).alias("processed"), F.count_if(F.col(error).isNotNull()).alias("quarantined"),
        *[F.count_if(F.array_contains(flags, n)).alias(f"n_{n}") for n in names],
    )


def quality_report(df: DataFrame, key: str, error: str, flags: str, names: list[str], numbers: list[str], group: str) -> DataFrame:
    """A run's report as lines of Markdown: (section, item, line), to be ordered by section and item.

    1 outcome, 2 a line for each row set aside, 3 flags, 4 groups of processed rows that share `group`, with their
    number and least key, 5 mean and range of numbers over processed rows. Only counters meet in one row; what grows
    with the table stays rows. No processed row: numbers read "none".
    """
    good = F.col(error).isNull()
    of = lambda c: F.when(good, F.col(c).cast("double"))
    ranges = [a.alias(f"_{i}_{n}") for i, c in enumerate(numbers) for n, a in (("mean", F.avg(of(c))), ("min", F.min(of(c))), ("max", F.max(of(c))))]
    counters = df.agg(F.count(F.lit(1)).alias("_all"), F.count_if(good).alias("_good"), *[F.count_if(F.array_contains(flags, n)).alias(f"_flag_{i}") for i, n in enumerate(names)], *ranges)
    line = lambda section, item, *parts: F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), F.concat(*parts).alias("line"))
    text = lambda c: F.col(c).cast("string")
    tenth = lambda c: F.format_string("%.1f", F.round(c, 1))
    lines = [
        line(1, "1", F.lit("- Records attempted: "), text("_all")), line(1, "2", F.lit("- Processed: "), text("_good")),
        line(1, "3", F.lit("- Quarantined: "), (F.col("_all") - F.col("_good")).cast("string")),
    ] + [line(3, n, F.lit(f"- {n}: "), text(f"_flag_{i}")) for i, n in enumerate(names)]
    for i, c in enumerate(numbers):
        stated = F.concat(F.lit("mean "), tenth(f"_{i}_mean"), F.lit(", min "), tenth(f"_{i}_min"), F.lit(", max "), tenth(f"_{i}_max"))
        lines.append(line(5, c, F.lit(f"- {c}: "), F.when(F.col(f"_{i}_mean").isNull(), "none").otherwise(stated)))
    fixed = counters.select(F.inline(F.array(*lines)))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    held = df.where(~good).select(F.lit(2).alias("section"), shown(key).alias("item"), F.concat(F.lit("| "), shown(key), F.lit(" | "), F.col(error), F.lit(" |")).alias("line"))
    several = df.where(good & F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("item")).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_first")).where("_n > 1")
    groups = several.select(F.lit(4).alias("section"), "item", F.concat(F.lit("- `"), "item", F.lit("`: "), text("_n"), F.lit(" records, first "), shown("_first")).alias("line"))
    return fixed.unionByName(held).unionByName(groups)


def quarantine(df: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows that go on, and rows set aside with their reason; none is lost."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())
