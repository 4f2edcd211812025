"""Real fits on small tables whose areas have known bounds, and exact measures against plain Python."""

import math
import threading
import time

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lodestone.operators import fits, metrics, ml


@pytest.fixture(scope="module")
def rows(spark):
    """The label follows two numbers of d; f is noise; g deals the rows out."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] + x[:, 1] > 0.3).astype(int)
    data = [(i, int(y[i]), int(i % 10), x[i, :3].tolist(), x[i, 3:].tolist()) for i in range(400)]
    df = spark.createDataFrame(data, "id long, y int, g int, d array<double>, f array<float>")
    df = df.join(ml.permuted_labels(df.where("g < 7"), "id", "y", 4), "id", "left")
    return fits.matrix(df, ["id", "y", "g", "y_0", "y_1", "y_2", "y_3"], {"features": ["d", "f"], "d": ["d"], "f": ["f"]}, 12)


TRAIN, VALID, TEST = "g < 7", "g = 8", "g = 9"
small = lambda label="y", features="features", seed=42: ml.forest(label, "weight", 8, 5, seed, features)


def weighed(rows, part):
    learn = rows.where(part)
    return learn.withColumn("weight", fits.balanced(learn, "y"))


def test_matrix_holds_vectors_and_one_file_for_few_rows(spark, rows, monkeypatch):
    r = rows.where("id = 5").first()
    assert len(r.features) == 6 and r.features.toArray().tolist() == [*r.d.toArray(), *r.f.toArray()]
    assert len(rows.inputFiles()) == 1
    monkeypatch.setattr(fits, "FILE_VALUES", 1_000)
    assert len(fits.matrix(spark.range(500).withColumn("a", F.array("id")), ["id"], {"v": ["a"]}, 10).inputFiles()) == 5


def test_fits_run_side_by_side_and_failures_are_raised(spark):
    at_once, most, lock = [], [], threading.Lock()

    def job():
        with lock:
            at_once.append(1)
            most.append(len(at_once))
        time.sleep(0.2)
        n = spark.range(10).count()
        with lock:
            at_once.pop()
        return n

    assert fits.side_by_side(spark, {str(i): job for i in range(7)}, 3) == {str(i): 10 for i in range(7)}
    assert 2 <= max(most) <= 3
    with pytest.raises(ZeroDivisionError):
        fits.side_by_side(spark, {"a": job, "b": lambda: 1 // 0})


def test_balanced_weights(rows):
    sums = weighed(rows, TRAIN).groupBy("y").agg(F.sum("weight")).collect()
    assert sums[0][1] == pytest.approx(140) and sums[1][1] == pytest.approx(140)


def test_models_score_after_an_observation(spark, rows):
    """A session in which something was observed can't be serialised; models mustn't hold it."""
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 3
    lr = ml.candidates("y", "weight")["lr"]
    found = fits.outcomes(spark, {"forest": fits.Fit(small(), weighed(rows, TRAIN), rows.where(TEST), "y"), "lr": fits.Fit(lr, weighed(rows, TRAIN), rows.where(TEST), "y")})
    assert all(o.auc > 0.85 for o in found.values())


def test_champion_and_its_scrambling(spark, rows):
    models = ml.candidates("y", "weight", trees=(5, 8), depths=(4,), rounds=5)
    name, found = ml.select_champion(weighed(rows, TRAIN), rows.where(VALID), "y", models)
    assert set(found) == {"rf_5_4", "rf_8_4", "gbm", "lr"} and found[name].auc == max(o.auc for o in found.values()) > 0.95
    r = ml.scramble_test(rows, TRAIN, VALID, "y", 4, lambda y: ml.candidates(y, "weight")["lr"])
    assert r.real > 0.97 and r.least <= r.mean <= r.most and r.real - r.mean > 0.2 and r.passed == (abs(r.mean - 0.5) < 0.07 and r.real - r.mean > 3 * r.sd)


def test_stability_ablation_gap_and_importances(spark, rows):
    train, test = rows.where(TRAIN), rows.where(TEST)
    found = ml.stability(train, test, "id", "y", lambda s: small(seed=s), (1, 2), (0, 1, 2))
    assert set(found) == {"seed_1", "seed_2", "bootstrap_0", "bootstrap_1", "bootstrap_2"} and all(o.auc > 0.85 for o in found.values())
    assert len({o.auc for o in found.values()}) > 1
    by = ml.ablation(train, test, "y", ["d", "f", "features"], lambda v: small(features=v))
    assert by["d"].auc > 0.9 > 0.8 > by["f"].auc and by["features"].auc > 0.85
    gap = ml.split_gap(rows, "id", "y", TRAIN, TEST, small)
    assert all(o.auc > 0.85 and o.balanced_accuracy > 0.7 for o in gap.values())
    model = small().fit(weighed(rows, TRAIN))
    top = [r.feature for r in ml.importances(model, [f"x{i}" for i in range(6)], spark).limit(2).collect()]
    assert set(top) == {"x0", "x1"}


def test_baselines_and_recalibration(spark, rows):
    several = {k: fits.Fit(e, weighed(rows, TRAIN), rows.where(TEST), "y") for k, e in ml.baselines("y", "weight", "d", trees=6).items()}
    assert all(o.auc > 0.9 for o in fits.outcomes(spark, several).values())
    cal = spark.createDataFrame([(i, i / 200, int(i % 20 < i / 20)) for i in range(200)], "id int, p double, y int")
    out = ml.isotonic(cal, "p", "y")(ml.platt(cal, "p", "y")(cal)).orderBy("p").collect()
    assert all(a.platt <= b.platt and a.isotonic <= b.isotonic for a, b in zip(out, out[1:]))
    assert sum(r.platt for r in out) / 200 == pytest.approx(sum(r.y for r in out) / 200, abs=0.01) and 0 <= out[0].isotonic <= out[-1].isotonic <= 1


def plain_auc(scores):
    pos, neg = ([s for s, y in scores if y == k] for k in (1, 0))
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("range_rows", [7, 100_000])
def test_areas_and_quantiles_in_ranges(spark, monkeypatch, range_rows):
    monkeypatch.setattr(metrics, "RANGE_ROWS", range_rows)
    rng = np.random.default_rng(8)
    scores = [(round(float(rng.random()), 2), int(rng.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(scores, "p double, y int")
    r = metrics.area_and_balance(metrics.score_counts(df, "p", "y")).first()
    tpr, tnr = np.mean([p >= 0.5 for p, y in scores if y]), np.mean([p < 0.5 for p, y in scores if not y])
    assert r.auc == pytest.approx(plain_auc(scores)) and r.balanced_accuracy == pytest.approx((tpr + tnr) / 2)
    at = [0.0, 0.05, 1 / 3, 0.5, 0.95, 1.0]
    assert metrics.quantiles(df.unionByName(spark.createDataFrame([(None, 1)], "p double, y int")), "p", at) == pytest.approx(np.quantile([s for s, _ in scores], at))
    assert metrics.quantiles(df.limit(0), "p", [0.5]) == [None]


def test_bootstrap_does_not_depend_on_ranges(spark, monkeypatch):
    rng = np.random.default_rng(5)
    scores = [(float(s), int(s + rng.normal() > 0.2)) for s in rng.normal(size=500)]
    df = spark.createDataFrame(scores, "p double, y int")
    found = []
    for rows in (11, 100_000):
        monkeypatch.setattr(metrics, "RANGE_ROWS", rows)
        found.append(metrics.bootstrap_auc(df.repartition(3), "p", "y", replicates=400).first())
    assert found[0].replicates == 400 and tuple(found[0]) == pytest.approx(tuple(found[1]))
    auc, n = plain_auc(scores), 500
    assert found[0].low < auc < found[0].high and found[0].high - found[0].low == pytest.approx(3.92 * math.sqrt(auc * (1 - auc) / n), rel=0.6)
    # A cell of very many rows has its own Poisson mean and spread: 3 of mean a million.
    big = metrics._range_areas(2_000)(__import__("pandas").DataFrame({"score": [1.0], "one": [True], "n": [1_000_000], "seed": [7], "_range": [0]}))
    assert abs(big.pos.mean() - 1e6) < 100 and abs(big.pos.std() / 1e3 - 1) < 0.1
    assert metrics.bootstrap_auc(df.where("y = 1"), "p", "y", replicates=5).first().replicates == 0
