"""Many fits over one matrix.

The matrix is written once, as vectors, and every fit and every score reads that table: nothing joined or
computed is done again for each fit. Fits are jobs of their own and go out side by side, a bounded number at a
time, each in a scheduler pool of its own; forests that share trees are one job.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodestone.operators import forests
from lodestone.operators.metrics import area_and_balance, score_counts
from lodestone.session import scratch_path

#: So many fits run at a time.
AT_ONCE = 8
#: About so many numbers of the matrix make a file.
FILE_VALUES = 16_000_000


def vector(arrays: list[str]) -> Column:
    """The arrays end to end as the struct that a dense vector is stored as."""
    values = F.concat(*[F.col(a).cast("array<double>") for a in arrays])
    return F.struct(F.lit(1).cast("byte").alias("type"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("array<int>").alias("indices"), values.alias("values"))


def matrix(df: DataFrame, keep: list[str], vectors: dict[str, list[str]], width: int) -> DataFrame:
    """The kept columns and the named vectors, each of some array columns of df, as a written table.

    width: about how many numbers a row has; files hold FILE_VALUES, so a small matrix is one task's.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "matrix")
    files = max(1, -(-df.count() * width // FILE_VALUES))
    rows = df.select(*keep, *[vector(arrays).alias(name) for name, arrays in vectors.items()])
    rows.repartition(files, F.xxhash64(keep[0])).write.parquet(path)
    fields = {f.name: f for f in rows.schema.fields}
    return spark.read.schema(StructType([fields[k] for k in keep] + [StructField(name, VectorUDT()) for name in vectors])).parquet(path)


def balanced(df: DataFrame, label: str, copies: Column | None = None) -> Column:
    """The weight n / (2 n_class), times a row's copies: both classes weigh alike. Two sums reach the driver."""
    n = F.lit(1) if copies is None else copies
    ones, zeros = df.agg(F.sum(F.when(F.col(label) == 1, n)), F.sum(F.when(F.col(label) != 1, n))).first()
    ones, zeros = float(ones or 0), float(zeros or 0)
    weight = F.when(F.col(label) == 1, (ones + zeros) / (2 * max(ones, 1.0))).otherwise((ones + zeros) / (2 * max(zeros, 1.0)))
    return weight if copies is None else weight * copies


def side_by_side(spark: SparkSession, jobs: dict[str, Callable], at_once: int = AT_ONCE) -> dict:
    """What each job returns, by name; the first failure is raised once the running ones end."""

    def run(name: str, job: Callable):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{name}")
        return job()

    with ThreadPoolExecutor(at_once) as pool:
        found = {name: pool.submit(inheritable_thread_target(spark)(run), name, job) for name, job in jobs.items()}
        try:
            return {name: f.result() for name, f in found.items()}
        except BaseException:
            pool.shutdown(cancel_futures=True)
            raise


class Fit(NamedTuple):
    """An estimator, the rows it learns from and those it is judged on, and the label of the latter; also: more
    rows that its model is to score later."""

    estimator: object
    train: DataFrame
    test: DataFrame
    label: str
    also: DataFrame | None = None


class Outcome(NamedTuple):
    model: object
    auc: float
    balanced_accuracy: float


def slim(model):
    """The model without its training summary. The summary holds the session, and a session in which anything was
    observed can't be serialised, so that a model with one could no longer score: tasks get the whole model."""
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.apply(None))
    return model


def probability(model, df: DataFrame, out: str = "p") -> DataFrame:
    if isinstance(model, forests.Grown):
        return model.probability(df, out)
    return model.transform(df).withColumn(out, vector_to_array("probability")[1])


def judged(model, df: DataFrame, label: str) -> Outcome:
    row = area_and_balance(score_counts(probability(model, df), "p", label)).first()
    return Outcome(model, row["auc"], row["balanced_accuracy"])


def together(fits: dict[str, Fit]) -> list[list[str]]:
    """Names of the forests that learn alike but for their trees, depth and seed: they are grown at once."""
    alike: dict[tuple, list[str]] = {}
    for name, f in fits.items():
        if isinstance(e := f.estimator, RandomForestClassifier):
            alike.setdefault((id(f.train), id(f.test), id(f.also), e.getLabelCol(), e.getFeaturesCol(), e.getWeightCol(), e.getMaxBins()), []).append(name)
    return list(alike.values())


def grown(fits: list[Fit]) -> list[forests.Grown]:
    f, e = fits[0], fits[0].estimator
    judged = f.test if f.also is None else f.test.unionByName(f.also)
    kinds = [forests.Kind(x.estimator.getNumTrees(), x.estimator.getMaxDepth(), x.estimator.getSeed()) for x in fits]
    return forests.grow(f.train, judged, e.getFeaturesCol(), e.getLabelCol(), e.getWeightCol(), kinds, e.getMaxBins())


def outcomes(spark: SparkSession, fits: dict[str, Fit], at_once: int = AT_ONCE) -> dict[str, Outcome]:
    """Each fit's model and its measures on its test rows. Random forests are grown by tasks, the others by their estimators."""
    trees = together(fits)
    rest = [k for k in fits if not any(k in names for names in trees)]
    jobs = {"+".join(names): lambda names=names: dict(zip(names, grown([fits[k] for k in names]))) for names in trees}
    jobs |= {k: lambda k=k: {k: slim(fits[k].estimator.fit(fits[k].train))} for k in rest}
    models = {k: m for found in side_by_side(spark, jobs, at_once).values() for k, m in found.items()}
    return side_by_side(spark, {k: lambda k=k: judged(models[k], fits[k].test, fits[k].label) for k in fits}, at_once)
