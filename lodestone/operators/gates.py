"""Validation gates as hard stops.

A gate evaluates all its rules in one pass: each row gets the list of the rules it breaks, good rows and
quarantine go out in one write, partitioned by which they are, and the counts come from an observation of that
write. After the write a gate with a breach raises, so the quarantine is there to look at and nothing
after the gate starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.session import scratch_path


class Gate(NamedTuple):
    """Conditions that rows must not fail; one that is null isn't a breach. found: breaches that a row can't show
    alone, as (rule, key) frames made from the rows, such as constraints.repeated."""

    name: str
    rules: dict[str, Column]
    found: Callable[[DataFrame], DataFrame] | None = None
    tolerated: float = 0.0


class GateStopped(Exception):
    """A gate found breaches beyond what it tolerates. counts: rows, quarantined and breaches by rule; path: the
    table whose rows with kept = false are the quarantine."""

    def __init__(self, gate: str, counts: dict[str, int], path: str):
        super().__init__(f"gate {gate}: {counts['quarantined']} of {counts['rows']} rows are quarantined in {path}")
        self.gate, self.counts, self.path = gate, counts, path


def judge(df: DataFrame, key: str, gate: Gate) -> DataFrame:
    """df with broken, the names of the rules that each row breaks, in the rules' order, then those of found."""
    own = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(rule)) for rule, ok in gate.rules.items()], F.lit(None).cast("string")))
    rows = df.withColumn("broken", own)
    if gate.found is None:
        return rows
    others = gate.found(df).groupBy(F.col("key").alias("_breach")).agg(F.array_sort(F.collect_set("rule")).alias("_others"))  # a few rules for each key
    joined = rows.join(others, F.col(key).cast("string") == F.col("_breach"), "left")
    return joined.withColumn("broken", F.concat("broken", F.coalesce("_others", F.array().cast("array<string>")))).drop("_breach", "_others")


def passed(df: DataFrame, key: str, gate: Gate, path: str | None = None) -> DataFrame:
    """The rows that pass the gate, read back from the table at path; raises GateStopped where more than the
    tolerated share breaks a rule. df has no columns named broken and kept."""
    path = path or scratch_path(df.sparkSession, f"gate-{gate.name}")
    seen = Observation(f"gate-{gate.name}")
    breaches = [F.sum(F.array_contains("broken", rule).cast("long")).alias(rule) for rule in gate.rules]
    judged = judge(df, key, gate).withColumn("kept", F.size("broken") == 0)
    judged.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("kept")).alias("quarantined"), *breaches).write.partitionBy("kept").parquet(path)
    counts = {k: v or 0 for k, v in seen.get.items()}
    if counts["quarantined"] > gate.tolerated * counts["rows"]:
        raise GateStopped(gate.name, counts, path)
    written = df.sparkSession.read.schema(judged.schema).parquet(path)
    return written.where("kept").drop("kept", "broken")


def quarantine(spark, path: str) -> DataFrame:
    """What a gate held back, with the rules broken."""
    return spark.read.parquet(path).where("not kept").drop("kept")


def through(df: DataFrame, stages: Iterable[tuple[Callable[[DataFrame], DataFrame], str, Gate]]) -> DataFrame:
    """df through (transformation, key, gate) stages; a stage starts when the gate before it has let the rows
    pass, and none starts after a stop."""
    for transform, key, gate in stages:
        df = passed(transform(df), key, gate)
    return df
