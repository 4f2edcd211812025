"""Whole flows as single lazy plans: a training set, a batch of predictions with their envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.aggregate import aggregate_continuous, label_at
from lodestone.operators.reliability import BORDER, OUT, UNKNOWN, prediction_set
from lodestone.operators.split import split_group

#: Model states that may be served.
SERVABLE = ("VALIDATED FOR INTERNAL RESEARCH",)


def training_set(df: DataFrame, usable: Column, keys: list[str], value: str, threshold: float, salt: str) -> DataFrame:
    """Usable rows -> one aggregate per key -> concordant, positive ones -> label and split group.

    One shuffle, on the keys; the filter reaches the scan.
    """
    agg = aggregate_continuous(df.where(usable), keys, value)
    good = agg.where(~F.col("error") & ~F.col("discordant") & (F.col("value") > 0))
    return good.withColumn("label", label_at(F.col("value"), threshold)).withColumn(
        "split_group", split_group(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), salt)
    )


def exclusion_report(df: DataFrame, usable: Column, keys: list[str], value: str) -> DataFrame:
    """How many groups each exclusion drops."""
    agg = aggregate_continuous(df.where(usable), keys, value)
    return agg.agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("discordant")).alias("discordant"), F.count_if(F.col("error")).alias("errors"),
        F.count_if((F.col("n") == 1) & (F.col("value") <= 0)).alias("non_positive"),
    )


#: The warnings of a prediction, in the order in which they are given.
WARNINGS = ("undefined_stereochemistry", "out_of_domain", "borderline_domain", "applicability_domain_undeterminable", "conformal_set_ambiguous", "small_training_set")


def envelope(scored: DataFrame, p: str, p_one: str, p_zero: str, verdict: str, status: str, stereo: Column | None = None) -> DataFrame:
    """Predictions with their set, label and warnings; rows of models that may not be served go.

    stereo is the completeness of a structure's stereochemistry. Every prediction carries the warning
    that the training set is small.
    """
    chosen = prediction_set(F.col(p_one), F.col(p_zero))
    out = scored.where(F.col(status).isin(*SERVABLE)).withColumn("prediction_set", chosen)
    stereo = F.lit("defined") if stereo is None else stereo
    v = F.col(verdict)
    given = (stereo.isin("undefined", "partially_defined"), v == OUT, v == BORDER, v == UNKNOWN, F.size("prediction_set") != 1, F.lit(True))
    warnings = F.array_compact(F.array(*[F.when(condition, code) for condition, code in zip(given, WARNINGS)]))
    return out.withColumn("predicted", (F.col(p) >= 0.5).cast("int")).withColumn("warnings", warnings)


def endpoint_views(measurements: DataFrame, endpoints: DataFrame, classes: dict[str, str], endpoint: str, kind: str, deleted: str) -> list[str]:
    """One temporary view for each endpoint class, without deleted rows; returns the views' names."""
    joined = measurements.where(~F.col(deleted)).join(endpoints, endpoint)
    for view, name in classes.items():
        joined.where(F.col(kind) == name).createOrReplaceTempView(view)
    return list(classes)


def cross_species(organism: Column, cell_type: Column, confidence: Column, flagged: Column, expected: str = "human") -> Column:
    """Assays of another organism, of no stated cell type and middling confidence, not flagged yet."""
    return organism.isNotNull() & (organism != expected) & cell_type.isNull() & (confidence == 8) & ~flagged


def started_run(run: Column, at: Column) -> Column:
    return F.struct(run.alias("run_id"), F.lit("started").alias("state"), at.alias("at"), F.lit(None).cast("long").alias("parsed"), F.lit(None).cast("long").alias("imported"))


def completed_run(run: Column, at: Column, parsed: Column, imported: Column) -> Column:
    """An event of its own: the latest event of a run is its state."""
    return F.struct(run.alias("run_id"), F.lit("completed").alias("state"), at.alias("at"), parsed.cast("long").alias("parsed"), imported.cast("long").alias("imported"))


def run_status(events: DataFrame) -> DataFrame:
    """Per run of started_run's and completed_run's events, and of others in their form: started_at, completed_at,
    state (the latest event's; of several at one time the one that comes last by name), parsed and imported of the
    latest completion. Partial aggregates only."""
    done = F.col("state") == "completed"
    latest = lambda c: F.max(F.when(done, F.struct("at", "parsed", "imported")))[c]
    return events.groupBy("run_id").agg(
        F.min(F.when(F.col("state") == "started", F.col("at"))).alias("started_at"), latest("at").alias("completed_at"),
        F.max(F.struct("at", "state"))["state"].alias("state"), latest("parsed").alias("parsed"), latest("imported").alias("imported"),
    )
