"""Row picks, must-match joins, bands, unions of pools, months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.metrics import running_sums


def must_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined with right's one row for each of its keys; a left row without one, or with several, is an
    error."""
    counted = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, "left")
    missing, several = counted.agg(F.sum(F.when(F.col("_n").isNull(), F.col("_rows"))), F.sum(F.when(F.col("_n") > 1, F.col("_rows")))).first()
    if missing or several:
        raise ValueError(f"{missing or 0} rows match none, {several or 0} match more than one")
    return left.join(right, keys)


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """left with right's columns; where no row of right has the keys, and where its value is null, the default. Of
    right's rows of a key, which is an error elsewhere, the one whose values sort first counts: left keeps its rows."""
    values = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.min(F.struct(*values)).alias("_one")).select(*keys, *[F.col("_one")[c].alias(c) for c in values])
    return left.join(one, keys, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def without_mixtures(df: DataFrame, structure: str, mark: str = ".") -> tuple[DataFrame, DataFrame]:
    """Rows whose structure is one component, and one row with the number of the others."""
    mixture = F.coalesce(F.contains(F.col(structure), F.lit(mark)), F.lit(False))
    return df.where(~mixture), df.agg(F.count_if(mixture).alias("mixtures"), F.count(F.lit(1)).alias("rows"))


def near_threshold(value: Column, threshold: float, fold: float = 3.0) -> Column:
    """Within a fold of the threshold, bounds included."""
    return value.between(threshold / fold, threshold * fold)


def most_confident(df: DataFrame, score: str, label: str, key: str, wrong: int, n: int = 5) -> DataFrame:
    """The n most confident errors: wrong = 1 for false positives by falling score, 0 for false negatives by
    rising score; ties by key."""
    errors = df.where((F.col(label) == 1 - wrong) & ((F.col(score) >= 0.5) == F.lit(bool(wrong))))
    return errors.orderBy(F.desc(score) if wrong else F.asc(score), key).limit(n)


def row_at_fraction(df: DataFrame, order: str, tie: str, fraction: float) -> DataFrame:
    """The row at position floor(n * fraction), from 0, in the order. Counts at distinct values lead to the value
    of that row; only rows of that value are ordered."""
    counts = df.groupBy(F.col(order).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    at = F.least(F.floor(F.col("all__n") * fraction), F.col("all__n") - 1)
    hit = running_sums(counts, "_v", ["_n"]).where((F.col("before__n") <= at) & (at < F.col("before__n") + F.col("_n"))).select("_v", (at - F.col("before__n")).alias("_skip"))
    same = df.join(F.broadcast(hit), df[order].eqNullSafe(F.col("_v")))  # one row
    skip = same.select("_skip").first()
    return same.orderBy(tie).offset(skip[0] if skip else 0).limit(1).drop("_v", "_skip")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a hash of seed and key: the same ones however the rows are dealt."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def pool_union(**pools: DataFrame) -> DataFrame:
    """The pools' rows with the pool's name; columns that a pool lacks are null there."""
    out = None
    for name, df in pools.items():
        tagged = df.withColumn("pool", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def paired(left: Column, right: Column) -> Column:
    """Two arrays as one of struct<left, right> by position; arrays of unequal length, or null ones, are an error."""
    both = F.zip_with(left, right, lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return F.when(F.size(left) == F.size(right), both).otherwise(F.raise_error(F.lit("arrays of unequal length can't be paired")))


def month_bounds(day: Column) -> Column:
    """struct<first, next>: the first day of the day's month and of the month after."""
    first = F.trunc(day, "month")
    return F.struct(first.alias("first"), F.add_months(first, 1).alias("next"))


def month_series(day: Column, n: int = 10) -> Column:
    """First days of n months, from the day's own."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.add_months(F.trunc(day, "month"), i))


def holds_bits(candidate: Column, query: Column) -> Column:
    """Whether a candidate has every bit of the query: what a substructure match can't do without."""
    return F.size(F.array_except(query, candidate)) == 0


def substructure_candidates(df: DataFrame, bits: str, query: Column, matches: Column) -> DataFrame:
    """Rows that hold the query's bits and match; the match, of a toolchain, is asked of those alone."""
    return df.where(F.when(holds_bits(F.col(bits), query), matches).otherwise(False))


def row_of(df: DataFrame, key: str, value) -> DataFrame:
    """The rows with a key: a filter that reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def bit_examples(rows: DataFrame, key: str, bits: str, top: DataFrame, k: int = 2, seed: int = 42) -> DataFrame:
    """top (bit, ...) with example (1 to k) and key: k rows that set the bit, the first in a hash order of the seed.

    The map from bits to rows is made for top's bits alone, which are few; before anything is shuffled each task
    keeps its own first k of a bit.
    """
    held = rows.select(key, F.explode(F.array_distinct(bits)).alias("bit")).join(F.broadcast(top.select("bit")), "bit")  # top is a report's rows
    order = Window.partitionBy("bit").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    first = held.withColumn("example", F.row_number().over(order)).where(F.col("example") <= k)
    return top.join(first, "bit", "left")
