"""Trees grown in tasks: splits against all splits, forests against Spark's, and no forest in the driver."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.catalog import models
from lodestone.operators import fits, forests, ml

real_fit = RandomForestClassifier._fit


@pytest.fixture
def no_forest_in_the_driver(monkeypatch):
    def fit(*_):
        raise MemoryError("all trees in the driver")

    monkeypatch.setattr(RandomForestClassifier, "_fit", fit)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5)).round(2)
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=600) > 0.5).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(600)], "id long, y int, d array<double>")
    return fits.matrix(df, ["id", "y"], {"features": ["d"]}, 5)


def parts(rows):
    train = rows.where("id % 3 > 0")
    return train.withColumn("weight", fits.balanced(train, "y")), rows.where("id % 3 = 0")


def test_root_has_the_largest_gain_and_leaves_are_pure():
    rng = np.random.default_rng(1)
    x, y, w = rng.integers(0, 9, (80, 4)).astype(np.uint8), rng.integers(0, 2, 80).astype(np.uint8), rng.integers(1, 4, 80)
    grown, bag = forests.tree(x, y, w, 4, 30, 7, 2), np.random.default_rng([7, 2]).poisson(1.0, 80)
    gini = lambda at: (lambda n, p: 2 * p * (n - p) / n if n else 0.0)((w * bag)[at].sum(), (w * bag * y)[at].sum())
    gains = {(f, c): gini(x[:, f] >= 0) - gini(x[:, f] <= c) - gini(x[:, f] > c) for f in range(4) for c in range(9)}
    assert grown.gain[0] == pytest.approx(max(gains.values())) == pytest.approx(gains[grown.feature[0], grown.code[0]])
    at = (bag > 0) & [(x == row).all(1).sum() == 1 for row in x]
    fell = forests.shares(grown, x, [0, 1, 30])
    assert (fell[30][at] == y[at]).all() and len(set(fell[0])) == 1 and len(set(fell[1])) == 2
    assert forests.weights_of(grown, 4, 30).sum() == pytest.approx(1) and (forests.weights_of(grown, 4, 1) > 0).sum() == 1
    assert all(len(set(d)) == 3 and set(d) < set(range(7)) for d in forests.drawn(rng, 50, 7, 3).tolist())


def test_one_growth_gives_its_parts_however_dealt_out(spark, rows, monkeypatch):
    train, test = parts(rows)
    kinds = [forests.Kind(9, 30, 1), forests.Kind(4, 3, 1), forests.Kind(4, 30, 2)]
    read = lambda g: ({r["_key"]: r["p"] for r in g.votes.collect()}, g.featureImportances.toArray().tolist())
    found = [read(g) for g in forests.grow(train, test, "features", "y", "weight", kinds)]
    assert found[0] != found[2] and all(len(p) == 200 for p, _ in found)
    for name, n in (("TASK_TREES", 2), ("BLOCK_ROWS", 7), ("ENTRIES", 50)):
        monkeypatch.setattr(forests, name, n)
    assert found == [read(g) for g in forests.grow(train.repartition(5), test.repartition(3), "features", "y", "weight", kinds)]
    assert found[1] == read(forests.grow(train, test, "features", "y", "weight", kinds[1:2])[0])


def test_areas_and_importances_are_near_those_of_sparks_forest(spark, rows, no_forest_in_the_driver):
    train, test = parts(rows)
    made = ml.forest("y", "weight", 40, 30)
    ours = fits.outcomes(spark, {"a": fits.Fit(made, train, test, "y")})["a"]
    theirs = fits.judged(real_fit(made, train), test, "y")
    assert ours.auc > 0.9 and ours.auc == pytest.approx(theirs.auc, abs=0.03) and ours.balanced_accuracy == pytest.approx(theirs.balanced_accuracy, abs=0.05)
    assert ours.model.featureImportances.toArray() == pytest.approx(theirs.model.featureImportances.toArray(), abs=0.05)
    again = {r.id: r.p for r in fits.probability(ours.model, test.where("id < 30")).collect()}
    assert len(again) == 10 and np.mean([abs(r.p - again[r.id]) for r in fits.probability(theirs.model, test.where("id < 30")).collect()]) < 0.1


def test_rare_values_copies_and_odd_parts(spark):
    data = [(i, int(i == 5 or i % 40 == 7), [float(i == 5), float(i % 40 == 7), 1.0]) for i in range(400)]
    df = fits.matrix(spark.createDataFrame(data, "id long, y int, d array<double>"), ["id", "y"], {"v": ["d"]}, 3).withColumn("weight", F.lit(1.0))
    assert [e.tolist() for e in forests.edges(df, "v", 32)] == [[0, 1], [0, 1], [1]]
    twice = df.unionByName(df.where("id < 4"))
    g = forests.grow(df, twice, "v", "y", "weight", [forests.Kind(30, 30, 3)])[0]
    assert g.probability(twice, "p").count() == 404 and g.votes.count() == 400 and g.featureImportances[2] == 0
    p = {r.id: r.p for r in g.probability(df, "p").collect()}
    assert p[7] > 0.6 > 0.2 > p[8] and p[5] > p[8]
    alone = forests.grow(df.where("y = 1"), df, "v", "y", "weight", [forests.Kind(2, 30, 3)])[0]
    assert {r.p for r in alone.votes.collect()} == {1.0} and alone.featureImportances.toArray().tolist() == [0, 0, 0]
    assert forests.grow(df, df.limit(0), "v", "y", "weight", [forests.Kind(2, 3, 3)])[0].votes.count() == 0
    with pytest.raises(ValueError):
        forests.grow(df.limit(0), df, "v", "y", "weight", [forests.Kind(2, 30, 3)])


@pytest.fixture
def small(monkeypatch):
    """Fewer trees and rounds; the queries are as they are."""
    grid, all_of, base = ml.forests, ml.candidates, ml.baselines
    monkeypatch.setattr(ml, "forests", lambda label, weight, trees=(3, 5), depths=(4, 3), seed=42: grid(label, weight, trees, depths, seed))
    monkeypatch.setattr(ml, "candidates", lambda label, weight: {k: m for k, m in all_of(label, weight, trees=(3, 5), depths=(4, 3)).items() if k != "gbm"})
    monkeypatch.setattr(ml, "baselines", lambda *a: base(*a, trees=4))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Vectors of which the fourth number tells the label, so that forests win."""
    rng, at = np.random.default_rng(6), str(tmp_path_factory.mktemp("vectors"))
    x = rng.normal(size=(300, 64))
    x[:, 3] = np.abs(x[:, 3]) * np.where(np.arange(300) % 10 < 5, 1, -1) * (-1) ** (np.abs(x[:, 4]) > 1.5)
    spark.createDataFrame([(i, v.tolist(), i % 10) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


CHECKS = {
    "model_baselines": lambda r: {x.name for x in r} == {f"{a}_{b}" for a in ("descriptors", "three") for b in ("logistic", "forest")} | {"stratified"},
    "recalibration": lambda r: len(r) == len({x.vec_id for x in r}) > 10 and all(0 <= x.p <= 1 and 0 < x.platt < 1 and 0 <= x.isotonic <= 1 for x in r),
    "model_stability": lambda r: len(r) == 20 and len({x.auc for x in r}) > 5 and all(x.auc > 0.4 for x in r),
    "split_gap": lambda r: {x.name for x in r} == {"given", "random"},
    "feature_ablation": lambda r: {x.name for x in r} == {"descriptors", "fingerprint", "features"},
    "feature_importance": lambda r: len(r) == 10 and r[0].feature == "x3" and r[0].importance > r[9].importance > 0,
    "y_scramble": lambda r: len(r) == 1 and r[0].champion.startswith(("rf_", "lr")) and r[0].least <= r[0].mean <= r[0].most,
    "train_champion": lambda r: len(r) == 5 and sum(x.champion for x in r) == 1 and all((x.test_auc is not None) == x.champion for x in r),
}


@pytest.mark.parametrize("name", CHECKS)
def test_queries_gather_no_forest(spark, folder, small, no_forest_in_the_driver, name):
    found = catalog.load()[0][name](spark, folder).collect()
    assert CHECKS[name](found) and all(math.isfinite(v) for r in found for v in r if isinstance(v, float))
