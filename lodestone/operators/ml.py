"""Model selection, baselines, recalibration and stability on pyspark.ml."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.fits import Fit, Outcome, balanced, outcomes


def with_features(df: DataFrame, arrays: list[str], out: str = "features") -> DataFrame:
    """The arrays end to end as one vector."""
    return df.withColumn(out, array_to_vector(F.concat(*[F.col(a).cast("array<double>") for a in arrays])))


def forest(label: str, weight: str, trees: int, depth: int, seed: int = 42, features: str = "features") -> RandomForestClassifier:
    """30 is the largest depth of Spark's trees and stands for no limit. `fits.outcomes` grows forests by `forests.grow`: Spark's
    own fit gathers all trees in the driver."""
    return RandomForestClassifier(numTrees=trees, maxDepth=min(depth, 30), seed=seed, featuresCol=features, labelCol=label, weightCol=weight, cacheNodeIds=True)


def forests(label: str, weight: str, trees: tuple[int, ...] = (200, 500), depths: tuple[int, ...] = (30, 20), seed: int = 42) -> dict:
    """The grid of forests that a champion is chosen from."""
    return {f"rf_{t}_{d}": forest(label, weight, t, d, seed) for t in trees for d in depths}


def candidates(label: str, weight: str, seed: int = 42, trees: tuple[int, ...] = (200, 500), depths: tuple[int, ...] = (30, 20), rounds: int = 100) -> dict:
    """The forests, gradient boosting (whose rows weigh alike) and a logistic regression on standardised features."""
    boosted = GBTClassifier(maxIter=rounds, maxDepth=3, seed=seed, featuresCol="features", labelCol=label)
    linear = LogisticRegression(maxIter=2000, regParam=0.01, featuresCol="features", labelCol=label, weightCol=weight)
    return forests(label, weight, trees, depths, seed) | {"gbm": boosted, "lr": linear}


def select_champion(train: DataFrame, valid: DataFrame, label: str, models: dict, also: DataFrame | None = None) -> tuple[str, dict[str, Outcome]]:
    """The candidate with the largest validation area, the first among equals, and what each came to.
    train has a weight where the models use one; both are read once for every model. also: more rows that the
    models are to score."""
    found = outcomes(train.sparkSession, {k: Fit(m, train, valid, label, also) for k, m in models.items()})
    return max(found, key=lambda k: found[k].auc), found


def majority_baseline(train: DataFrame, label: str) -> Column:
    """The commoner class of train, 1 among equals, as a constant column."""
    n, ones = train.agg(F.count(F.lit(1)), F.sum(label)).first()
    return F.lit(int(2 * (ones or 0) >= (n or 0)))


def stratified_baseline(id_col: str, rate: float, seed: int = 42) -> Column:
    """1 at the given rate by a hash of the identifier."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_000)) < int(rate * 1_000_000)).cast("int")


def platt(calibration: DataFrame, p: str, label: str):
    """Logistic recalibration; returns a function DataFrame -> DataFrame that adds `platt`."""
    model = LogisticRegression(featuresCol="_v", labelCol=label, regParam=0.0).fit(calibration.withColumn("_v", array_to_vector(F.array(p))))
    slope, intercept = float(model.coefficients[0]), float(model.intercept)
    return lambda df: df.withColumn("platt", 1 / (1 + F.exp(-(F.col(p) * slope + intercept))))


def isotonic(calibration: DataFrame, p: str, label: str):
    """Monotone recalibration, clipped to the calibration's range."""
    model = IsotonicRegression(featuresCol=p, labelCol=label, predictionCol="isotonic").fit(calibration)
    return lambda df: model.transform(df)


def permuted_labels(df: DataFrame, id_col: str, label: str, runs: int) -> DataFrame:
    """The identifier and y_0 to y_(runs - 1): the labels permuted among the rows in a hash order of each run, so
    class sizes stay.

    Both orders of a run are positions in sorted ranges, all runs' in one plan, so no window holds all rows.
    """
    each = df.select(id_col, label, F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("_run"))
    a = positions(each.select("_run", id_col), F.xxhash64("_run", id_col), id_col, "_run")
    b = positions(each.select("_run", F.col(id_col).alias("_from"), F.col(label).alias("_label")), F.xxhash64(F.col("_run") + 1_000_003, "_from"), "_from", "_run")
    dealt = a.join(b, ["_run", "_position"])
    return dealt.groupBy(id_col).agg(*[F.max(F.when(F.col("_run") == r, F.col("_label"))).alias(f"y_{r}") for r in range(runs)])


def importance_shares(importances: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Share of all importance by kind of feature; kinds: kind -> pattern of its features' names."""
    kind = F.coalesce(*[F.when(F.col("feature").rlike(p), k) for k, p in kinds.items()], F.lit("other"))
    total = importances.agg(F.sum("importance").alias("_all"))  # one row
    sums = importances.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("features"), F.sum("importance").alias("_sum"))
    return sums.join(F.broadcast(total)).select("kind", "features", F.try_divide("_sum", "_all").alias("share"))


#: About so many rows are put in order in one task.
RANGE_ROWS = 250_000


def positions(df: DataFrame, order: Column, tie: str, *by: str) -> DataFrame:
    """df with _position, 0 to n - 1 by order and tie within the columns of by: counts of sorted ranges, summed,
    give offsets.

    order is a hash, so its leading bits cut it into even ranges, as many as the rows need.
    """
    from pyspark.sql import Window

    bits = max(1, (df.count() // RANGE_ROWS).bit_length())
    cut = df.withColumn("_o", order).withColumn("_range", F.shiftright("_o", 64 - bits))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of the ranges alone
    offsets = cut.groupBy(*by, "_range").count().select(*by, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_range").orderBy("_o", tie)
    return cut.join(offsets, [*by, "_range"]).withColumn("_position", F.row_number().over(inside) - 1 + F.col("_offset")).drop("_o", "_range", "_offset")


class Scramble(NamedTuple):
    real: float
    mean: float
    sd: float
    least: float
    most: float
    passed: bool


def scramble_test(rows: DataFrame, train: str, valid: str, label: str, runs: int, make) -> Scramble:
    """Areas with scrambled labels should be near a half and far below the real one.

    rows: a matrix with the label and its permutations y_0 to y_(runs - 1) as columns; train and valid are
    its parts' conditions; make(label) gives an estimator with the weight column `weight`. All runs are fitted side by side.
    """
    learn, judge = rows.where(train), rows.where(valid)
    weighed = lambda y: learn.withColumn("weight", balanced(learn, y))
    found = outcomes(rows.sparkSession, {y: Fit(make(y), weighed(y), judge, label) for y in (label, *[f"y_{r}" for r in range(runs)])})
    areas = [found[f"y_{r}"].auc for r in range(runs)]
    mean = sum(areas) / runs
    sd = (sum((a - mean) ** 2 for a in areas) / runs) ** 0.5
    real = found[label].auc
    return Scramble(real, mean, sd, min(areas), max(areas), abs(mean - 0.5) < 0.07 and real - mean > 3 * max(sd, 1e-6))


def importances(model, names: list[str], spark) -> DataFrame:
    """Features by importance; as many rows as there are features."""
    values = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def baselines(label: str, weight: str, features: str, trees: int = 300, seed: int = 42) -> dict:
    """Weighted logistic regression and random forest on a feature column of few descriptors."""
    common = {"featuresCol": features, "labelCol": label, "weightCol": weight}
    return {"logistic": LogisticRegression(maxIter=2000, standardization=True, **common), "forest": RandomForestClassifier(numTrees=trees, maxDepth=30, seed=seed, **common)}


def drawn(id_col: str, run: int) -> Column:
    """How often a bootstrap draws a row: a Poisson number of mean 1 by a hash of its identifier and the run."""
    unit = (F.pmod(F.xxhash64(F.lit(run), F.col(id_col)), F.lit(1 << 40)) + 0.5) / (1 << 40)
    cdf, term, total = [], 0.36787944117144233, 0.0
    for k in range(15):
        total += term
        cdf.append(total)
        term /= k + 1
    return sum(((unit >= c).cast("int") for c in cdf), F.lit(0))


def stability(train: DataFrame, test: DataFrame, id_col: str, label: str, make, seeds: tuple[int, ...], bootstraps: tuple[int, ...]) -> dict[str, Outcome]:
    """Measures for each seed, and for each bootstrap of the training rows; make(seed) gives an estimator with
    the weight column `weight`, and bootstraps have its first seed."""
    weighed = lambda df, n=None: df.withColumn("weight", balanced(df, label, n))
    whole = weighed(train)
    fits = {f"seed_{s}": Fit(make(s), whole, test, label) for s in seeds}
    for r in bootstraps:
        rows = train.withColumn("_n", drawn(id_col, r)).where("_n > 0")
        fits[f"bootstrap_{r}"] = Fit(make(seeds[0]), weighed(rows, F.col("_n")), test, label)
    return outcomes(train.sparkSession, fits)


def ablation(train: DataFrame, test: DataFrame, label: str, variants: list[str], make) -> dict[str, Outcome]:
    """Measures with each vector column as the only features; make(column) gives an estimator with the weight
    column `weight`."""
    rows = train.withColumn("weight", balanced(train, label))
    return outcomes(train.sparkSession, {v: Fit(make(v), rows, test, label) for v in variants})


def stratified_split(df: DataFrame, id_col: str, label: str, fraction: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows at random into train and test with the test's share of each class: by a hash of the identifier,
    below each class's exact quantile."""
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(id_col)).cast("double"))
    edge = hashed.groupBy(label).agg(F.percentile_approx("_h", fraction, 100_000).alias("_edge"))  # a row for each class
    placed = hashed.join(F.broadcast(edge), label).withColumn("_test", F.col("_h") <= F.col("_edge")).drop("_h", "_edge")
    return placed.where("not _test").drop("_test"), placed.where("_test").drop("_test")


def split_gap(rows: DataFrame, id_col: str, label: str, train: str, test: str, make, seed: int = 42) -> dict[str, Outcome]:
    """Measures under the given split, and under a stratified random one whose test part is as large; make()
    gives an estimator with the weight column `weight`."""
    n, held = rows.agg(F.count(F.lit(1)), F.count_if(F.expr(test))).first()
    learn, rest = stratified_split(rows, id_col, label, held / n, seed)
    weighed = lambda df: df.withColumn("weight", balanced(df, label))
    return outcomes(rows.sparkSession, {"given": Fit(make(), weighed(rows.where(train)), rows.where(test), label), "random": Fit(make(), weighed(learn), rest, label)})


def mahalanobis(train: DataFrame, df: DataFrame, values: str, out: str = "mahalanobis", ridge: float = 1e-6) -> DataFrame:
    """df with the distance of its vectors from train's mean under train's covariance.

    Sums and products are aggregated by pyspark.ml; what reaches the driver is the covariance, as wide as
    the vectors. Null vectors have a null distance.
    """
    import numpy as np
    from pyspark.ml.stat import Correlation, Summarizer

    v = with_features(train.where(F.col(values).isNotNull()), [values], "_v")
    mean, sd = (np.array(x) for x in v.agg(Summarizer.mean(F.col("_v")), Summarizer.std(F.col("_v"))).first())
    corr = np.nan_to_num(Correlation.corr(v, "_v").first()[0].toArray())
    np.fill_diagonal(corr, 1.0)
    sd[sd == 0] = 1.0
    root = np.linalg.cholesky(np.linalg.inv(corr + ridge * np.eye(len(sd)))).T  # whitens the standardised vector
    unit = F.zip_with(F.zip_with(values, F.lit(mean.tolist()), lambda x, m: x - m), F.lit(sd.tolist()), lambda x, s: x / s)
    dot = lambda row: F.aggregate(F.zip_with("_unit", F.lit(row), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    squares = [F.pow(dot(row.tolist()), 2) for row in root]
    return df.withColumn("_unit", unit).withColumn(out, F.sqrt(sum(squares, F.lit(0.0)))).drop("_unit")
