"""Restored tables, look-ups, elements, examples of bits, sketches and SQL functions on small tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars, sql
from lodestone.operators import drift, reliability, selection, sketches
from lodestone.sources import writers


def test_restore_wants_the_recorded_content(spark, folder):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(20)], "id int, name string")
    copy, target = f"{folder}/copy", f"{folder}/table"
    writers.write_once(df, copy)
    recorded = tuple(writers.content_digest(df).first())
    assert writers.restore(spark, copy, recorded, target) == 20
    with pytest.raises(writers.RestoreRefused, match="there already"):
        writers.restore(spark, copy, recorded, target)
    with pytest.raises(writers.RestoreRefused, match="isn't what was recorded"):
        writers.restore(spark, copy, (20, "1"), target, force=True)
    changed = writers.replace(spark.read.parquet(target).where("id < 5"), target)
    assert changed.count() == 5 and spark.read.parquet(f"{target}.before").count() == 20
    assert writers.restore(spark, copy, recorded, target, force=True) == 20
    assert spark.read.parquet(target).count() == 20 and spark.read.parquet(f"{target}.pre-restore").count() == 5


def test_lookup_keeps_rows_and_fills(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, v string")
    right = spark.createDataFrame([(2, "two", 5), (2, "again", 6), (3, "three", 1), (1, None, 4)], "k int, name string, n int")
    got = sorted(tuple(r) for r in selection.looked_up(left, right, ["k"], {"name": "?", "n": 0}).select("v", "name", "n").collect())
    assert got == [("a", "?", 4), ("b", "again", 6), ("c", "again", 6), ("d", "?", 0)]


def test_elements_of_formulas(spark):
    cases = {"C9H8O4": {"C": 9, "H": 8, "O": 4}, "CH3CH2OH": {"C": 2, "H": 6, "O": 1}, "NaCl": {"Na": 1, "Cl": 1}, "C2H6N+1": {"C": 2, "H": 6, "N": 1}, "B": {"B": 1}, "": {}, "12": {}, None: None}
    df = spark.createDataFrame([(f,) for f in cases], "f string")
    got = {r.f: r.e for r in df.select("f", scalars.elements(F.col("f")).alias("e")).collect()}
    assert got == cases
    known = F.array(*map(F.lit, ("C", "H", "O", "N")))
    unseen = {r.f: (r.u, r.v) for r in df.withColumn("u", scalars.unseen_elements(F.col("f"), known)).select("f", "u", reliability.verdict_with_elements(F.lit("in_domain"), F.col("u")).alias("v")).collect()}
    assert unseen["NaCl"] == (["Cl", "Na"], "out_of_domain") and unseen["C9H8O4"] == ([], "in_domain") and unseen[None] == (None, "in_domain")


def test_bit_examples_are_the_first_by_hash_and_bounded_before_the_shuffle(spark):
    import hashlib

    rng = random.Random(3)
    sets = {i: sorted(rng.sample(range(6), 3)) for i in range(60)}
    rows = spark.createDataFrame([*sets.items(), (99, None)], "id int, bits array<int>")
    top = spark.createDataFrame([(0, 0.5), (4, 0.25), (77, 0.1)], "bit int, importance double")
    found = selection.bit_examples(rows, "id", "bits", top, k=3)
    got = sorted((r.bit, r.example, r.id) for r in found.collect() if r.id is not None)
    by_hash = lambda b: sorted((i for i, x in sets.items() if b in x), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:3]
    assert got == [(b, n, i) for b in (0, 4) for n, i in enumerate(by_hash(b), 1)]
    assert found.where("bit = 77").first().id is None
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_sketches_merge_and_keep_their_errors(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 20_000), rng.gauss(i % 2, 1), rng.choice(["a", "b", None])) for i in range(30_000)]
    df = spark.createDataFrame(rows, "k int, x double, s string").withColumn("half", F.monotonically_increasing_id() % 2)
    whole = sketches.sketched(df, ["k", "x", "s"])
    parts = sketches.merged(*[sketches.sketched(df.where(F.pmod("k", F.lit(5)) == i), ["k", "x", "s"]) for i in range(5)])
    for s in (whole, parts):
        got = {r.column: r for r in s.select("column", "n", "nulls", F.hll_sketch_estimate("distinct_sketch").alias("d")).collect()}
        assert got["s"].nulls == sum(r[2] is None for r in rows) and got["s"].d == 2 and got["k"].n == 30_000
        exact = len({r[0] for r in rows})
        assert abs(got["k"].d - exact) <= 4 * sketches.DISTINCT_ERROR * exact
    shifted = df.withColumn("x", F.col("x") + 0.8).withColumn("s", F.lit(None).cast("string"))
    m = {r.column: r for r in sketches.monitored(parts, sketches.sketched(shifted, ["k", "x", "s"])).collect()}
    assert abs(m["x"].distance - drift.kolmogorov_smirnov(df, shifted, "x").first()[0]) <= 4 * sketches.RANK_ERROR + 0.01
    assert m["k"].distance <= 4 * sketches.RANK_ERROR and m["s"].distance is None and m["s"].new_null_rate == 1
    empty = sketches.sketched(df.limit(0), ["x"])
    assert sketches.monitored(empty, empty).first().distance is None


def test_sql_functions_equal_the_column_functions_and_are_inlined(spark):
    assert sql.register(spark) == list(sql.FUNCTIONS)
    rows = [(s, d, seen) for s in (None, 0.1, 0.4, 0.5, 0.6, 0.9) for d in (None, 0.5, 2.0) for seen in (None, True, False)]
    df = spark.createDataFrame(rows, "s double, d double, seen boolean")
    both = df.select(F.expr("domain_verdict(s, d, 1D, seen)").alias("a"), reliability.ad_verdict(F.col("s"), F.col("d"), F.lit(1.0), F.col("seen")).alias("b"))
    assert all(r.a == r.b for r in both.collect()) and len({r.a for r in both.collect()}) == 4
    assert "domain_verdict" not in both._jdf.queryExecution().optimizedPlan().toString().replace("domain_verdict(s, d", "")
    p = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([(0.5, 0.5), (0.1, 0.09), (0.05, 0.2), (0.0, 0.0)])], "i int, a double, b double")
    p.createOrReplaceTempView("ps")
    got = Counter((r.i, r.label) for r in spark.sql("SELECT i, label FROM ps, LATERAL prediction_set(a, b)").collect())
    want = Counter((r.i, x) for r in p.select("i", reliability.prediction_set(F.col("a"), F.col("b")).alias("set")).collect() for x in r.set)
    assert got == want
