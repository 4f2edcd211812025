"""Operators on small tables of edge cases, and a few against plain models."""

import math
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import aggregate, chemistry, constraints, dedup, governance, likeness, metrics, reliability, similarity, split, units

GROUPS = {
    "single": ([5.0], 5.0, 0.0, False), "geometric": ([1.0, 100.0], 10.0, 2.0, True), "boundary": ([1.0, 10.0], math.sqrt(10), 1.0, False),
    "over": ([1.0, 10.001], math.sqrt(10.001), math.log10(10.001), True), "close": ([10.0, 12.0, 11.0], 1320 ** (1 / 3), math.log10(1.2), False),
}


def test_potency_groups(spark):
    rows = [(k, v) for k, (vs, *_) in GROUPS.items() for v in vs] + [("bad", 10.0), ("bad", -5.0), ("zero", 10.0), ("zero", 0.0), ("one_bad", -1.0), ("null", None)]
    got = {r.k: r for r in aggregate.aggregate_continuous(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k, (_, value, spread, discordant) in GROUPS.items():
        assert got[k].value == pytest.approx(value) and got[k].spread == pytest.approx(spread, abs=1e-12) and got[k].discordant is discordant
    assert got["bad"].error and got["zero"].error and got["bad"].value is None and got["zero"].discordant is None
    assert got["one_bad"].value == -1.0 and not got["one_bad"].error and "null" not in got


def test_medians_of_signed_values(spark):
    rows = [("a", x) for x in (5.0, 5.5, 6.0, 1000.0)] + [("b", -1.0), ("b", 0.5)]
    got = {r.k: r for r in aggregate.aggregate_continuous(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", potency=False).collect()}
    assert got["a"].value == 5.75 and got["b"].spread == 1.5 and got["b"].discordant


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abc"), st.floats(0.01, 1e6)), min_size=1, max_size=30))
def test_aggregates_equal_a_plain_model(spark, rows):
    got = {r.k: r for r in aggregate.aggregate_continuous(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k in {r[0] for r in rows}:
        vs = [v for g, v in rows if g == k]
        assert got[k].value == pytest.approx(vs[0] if len(vs) == 1 else 10 ** statistics.mean(map(math.log10, vs)))


def test_votes(spark):
    rows = [("a", True), ("a", True), ("a", False), ("b", True), ("b", False), ("c", False), ("d", None)]
    got = {r.k: (r.value, r.discordant, r.method) for r in aggregate.aggregate_binary(spark.createDataFrame(rows, "k string, y boolean"), ["k"], "y").collect()}
    assert got == {"a": (1.0, False, "majority_vote"), "b": (0.5, True, "majority_vote"), "c": (0.0, False, "single_value")}


def test_duplicates_and_representatives(spark):
    rows = [("r1", "K", "T", "doi", "red", 0.9, 1), ("r2", "K", "T", "doi", "amber", 0.1, 2), ("r3", "K", "T", "", "green", 0.5, 3), ("r4", "K", "T", None, "green", 0.7, 4), ("r5", "K", "U", "doi", "odd", 1.0, 5)]
    df = spark.createDataFrame(rows, "id string, e string, t string, ref string, tier string, c double, seq int")
    got = {r.reference: (r.n, r.representative) for r in dedup.measurement_duplicates(df, "e", "t", "ref", "tier", "c", "seq", "id").collect()}
    assert got == {"doi": (2, "r2"), None: (2, "r4")}
    groups = dedup.duplicate_groups(df, "t", "id", "seq").collect()
    assert sorted((r.t, r.n, r.representative, r.id) for r in groups) == [("T", 4, "r1", f"r{i}") for i in range(1, 5)]


def test_resolution_order(spark):
    rows = [("c", 2, "in_domain", 0.9, 5, 1), ("c", 1, None, None, 1, 2), ("c", 1, None, 0.2, 1, 3), ("d", 2, "out_of_domain", 0.99, 9, 4), ("d", 2, "in_domain", 0.1, 1, 5), ("e", 2, None, 0.5, 1, 6), ("e", 2, None, 0.5, 2, 7)]
    df = spark.createDataFrame(rows, "k string, p int, ad string, s double, t int, id int")
    assert {r.k: r.id for r in dedup.resolve(df, ["k"], "p", "ad", "s", "t", "id").collect()} == {"c": 3, "d": 5, "e": 7}


def test_split_group_is_the_digest_modulo_ten(spark):
    import hashlib

    keys = [f"k{i}" for i in range(50)] + ["", "é"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", split.split_group(F.col("k"), "salt").alias("g")).collect()
    assert all(r.g == int(hashlib.sha256(f"{r.k}||salt".encode()).hexdigest(), 16) % 10 for r in got)


def test_nearest_distance_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {i: np.sort(d[i])[:5].mean() for i in range(60)}
    for block, pivots in ((20_000, 512), (7, 512), (9, 3)):
        monkeypatch.setattr(similarity, "BLOCK_ROWS", block)
        monkeypatch.setattr(similarity, "PIVOTS", pivots)
        holes = df.unionByName(spark.createDataFrame([(99, None)], "id long, v array<double>"))
        got = {r.id: r.knn_distance for r in similarity.nearest_distance(holes, holes, "id", "v", exclude_self=True).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.75, 1.0])
def test_tanimoto_against_all_pairs(spark, threshold, monkeypatch):
    import random

    monkeypatch.setattr(similarity, "BLOCK_ROWS", 4)
    rng = random.Random(3)
    base = [sorted(rng.sample(range(130), rng.randint(0, 40))) for _ in range(25)]
    sets = base + [sorted({b for b in x if rng.random() > 0.1} | {rng.randrange(130)}) for x in base] + [[], [129]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)] + [(900, None)], "id long, bits array<int>")
    a, b = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    similar = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 0.0
    want = {(i, j): similar(sets[i], sets[j]) for i in range(0, len(sets), 2) for j in range(1, len(sets), 2)}
    got = [(r.a_id, r.b_id, r.similarity) for r in similarity.tanimoto_join(a, b, "id", "id", "bits", threshold).collect()]
    assert sorted(got) == sorted((*k, v) for k, v in want.items() if v >= threshold and v > 0)
    assert sorted(tuple(r) for r in similarity.tanimoto_join_by_prefix(a, b, "id", "id", "bits", threshold).collect()) == sorted(got)
    best = {r.id: r.max_similarity for r in similarity.max_similarity(a, b, "id", "bits").collect()}
    assert best == pytest.approx({i: max(v for (x, _), v in want.items() if x == i) for i in range(0, len(sets), 2)} | {900: 0.0})


def test_running_sums_over_ranges(spark, monkeypatch):
    from lodestone.operators import metrics

    rows = [(float(i * 7 % 1000), i) for i in range(1000)] + [(None, 5)]
    df = spark.createDataFrame(rows, "s double, v long")
    got = {r.s: (r.before_v, r.all_v) for r in metrics.running_sums(df, "s", ["v"]).collect()}
    want, total = {}, 0
    for s, v in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        want[s] = (total, sum(v for _, v in rows))
        total += v
    assert got == want


def test_leakage_gate_wants_every_check(spark):
    from lodestone.operators import split

    gate = lambda rows: tuple(split.leakage_gate(spark.createDataFrame(rows, "check string, status string"), ["a", "b"]).first())
    assert gate([("a", "PASS"), ("b", "PASS"), ("c", "REVIEW")]) == (True, 1)
    assert gate([("a", "PASS"), ("b", "REVIEW")]) == (False, 0)
    assert gate([("a", "PASS"), ("c", "PASS")]) == (False, 0)
    assert gate([("a", "PASS"), ("b", "PASS"), ("b", None)]) == (False, 0)


def test_closure_of_chains_and_cycles(spark):
    from lodestone.operators import governance

    chain = [(i, i + 1) for i in range(75)] + [(None, 4)]
    got = governance.closure(spark.createDataFrame(chain, "p int, c int"), "p", "c")
    assert {(r.ancestor, r.descendant, r.depth) for r in got.collect()} == {(str(i), str(j), j - i) for i in range(76) for j in range(i + 1, 76)}
    with pytest.raises(ValueError):
        governance.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "p int, c int"), "p", "c")


def test_verdicts(spark):
    rows = [(0.39, 0.0, True), (0.4, 0.0, True), (0.5, 2.0, True), (0.6, 0.0, True), (0.6, 0.0, None), (0.6, 2.0, False), (None, 1.0, True), (0.9, None, True)]
    df = spark.createDataFrame(rows, "s double, d double, seen boolean")
    got = [r[0] for r in df.select(reliability.ad_verdict(F.col("s"), F.col("d"), F.lit(1.0), F.col("seen"))).collect()]
    assert got == ["out_of_domain", "borderline", "out_of_domain", "in_domain", "borderline", "out_of_domain", "undeterminable", "undeterminable"]


def test_conformal_p_counts_ties(spark):
    alphas = spark.createDataFrame([(0.1,), (0.5,), (0.5,), (0.9,)], "alpha double")
    q = spark.createDataFrame([(0.5,), (0.95,), (0.0,)], "a double")
    assert {r.a: r.p_value for r in reliability.conformal_p(q, alphas, "a").collect()} == {0.5: 0.8, 0.95: 0.2, 0.0: 1.0}


def test_area_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1)], "p double, y int")
    assert metrics.roc_auc(metrics.score_counts(df, "p", "y")).first()[0] == 0.875
    assert metrics.roc_auc(metrics.score_counts(df.where("y = 1"), "p", "y")).first()[0] is None
    assert reliability.bin_of(F.lit(0.3)) is not None
    assert [r[0] for r in spark.createDataFrame([(0.3,), (0.0,), (1.0,), (0.6000000000000001,)], "p double").select(reliability.bin_of(F.col("p"))).collect()] == [2, 0, 9, 6]


def test_units(spark):
    df = spark.createDataFrame([(1.0,)] * 95 + [(1000.0,)] * 5, "v double").withColumn("k", F.lit("k"))
    assert units.verify_range(df, ["k"], "v", F.lit(0), F.lit(10)).first().passed
    skewed = spark.createDataFrame([(1.0,)] * 20 + [(1000.0,), (5000.0,), (10000.0,)], "v double").withColumn("k", F.lit("k"))
    assert not units.verify_skewness(skewed, ["k"], "v").first().passed and units.verify_skewness(skewed, ["k"], "v", log_scale=False).first().passed
    assert units.verify_skewness(skewed.limit(2), ["k"], "v").first().error
    refs = spark.createDataFrame([("good", 10.0, 50.0), ("flipped", 5.0, -5.0)], "n string, e double, o double")
    assert tuple(units.verify_references(refs, "e", "o").first()) == (2, False, 1)
    assert [r.n for r in units.failed_references(refs, "n", "e", "o").collect()] == ["flipped"]


def test_reference_verdict_names_its_failures(spark, folder):
    import duckdb

    from lodestone import catalog

    found, sql = catalog.load()
    accounts = {"some": [("a", 5000.0), ("c", 400.0), ("b", -5.0), ("d", None), (None, 0.0), ("c", 499.0), ("e", 500.0), ("f", 50000.0)], "none": [("a", 5000.0), ("b", 501.0)], "empty": []}
    want = {"some": (8, False, 4, ["b", "c", "c", None]), "none": (2, True, 0, [None]), "empty": (0, None, 0, [None])}
    for case, rows in accounts.items():
        spark.createDataFrame(rows, "s_name string, s_acctbal double").coalesce(1).write.parquet(f"{folder}/{case}/supplier.parquet")
        got = found["unit_reference"](spark, f"{folder}/{case}")
        assert got.columns == ["n", "passed", "failures", "s_name", "expected", "observed", "gap"]
        got = sorted(map(tuple, got.collect()), key=repr)
        assert {r[:3] for r in got} == {want[case][:3]} and sorted((r[3] for r in got), key=lambda n: (n is None, n)) == want[case][3]
        db = duckdb.connect()
        db.execute(f"CREATE VIEW supplier AS SELECT * FROM '{folder}/{case}/supplier.parquet/*.parquet'")
        assert sorted(db.execute(sql["unit_reference"]).fetchall(), key=repr) == got


def test_likeness_boundaries(spark):
    row = {"mw": 500.0, "logp": 5.0, "tpsa": 140.0, "mr": 40.0, "hbd": 5, "hba": 10, "rotb": 10, "heavy_atoms": 20, "ring_count": 7, "heteroatoms": 2, "carbons": 5, "logd": None}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in row.items()))
    got = df.select(*[c.alias(n) for n, c in likeness.rules({c: F.col(c) for c in df.columns}).items()]).first()
    assert got.lipinski_violations == 0 and got.veber_pass and not got.ghose_pass and got.muegge_pass and got.pfizer_3_75_flag is None
    charges = spark.createDataFrame([(-1, 75.0), (-1, 149.9), (-1, 150.0), (0, 10.0)], "q int, t double")
    assert [r[0] for r in charges.select(likeness.bioavailability(F.col("q"), F.col("t"), F.lit(True))).collect()] == [0.85, 0.56, 0.11, 0.55]


def test_violations_and_orphans(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id int, v int")
    assert [tuple(r) for r in constraints.violations(df, "id", {"positive": F.col("v") > 0}).collect()] == [("positive", "2")]
    parent = spark.createDataFrame([(5,)], "k int")
    assert [r.key for r in constraints.orphans(df, parent, "v", "k", "fk").collect()] == ["-1"]
    assert constraints.gate(constraints.violations(df, "id", {"any": F.lit(True)})).first().passed


def test_audit_needs_its_context(spark):
    df = spark.createDataFrame([(1, "a", False)], "id int, v string, gone boolean")
    with pytest.raises(ValueError):
        governance.audit_rows(df, df, "id", ["v"], "gone", "system", " ")
    assert governance.audit_rows(df, df, "id", ["v"], "gone", "system", "why").count() == 0


def test_identifiers(spark):
    one = spark.range(3).withColumn("u", scalars.new_ulid(F.col("id"))).withColumn("ms", scalars.ulid_millis(F.col("u")))
    import time

    rows = one.collect()
    assert len({r.u for r in rows}) == 3 and all(abs(r.ms / 1000 - time.time()) < 300 for r in rows)
    df = spark.createDataFrame([("2.0", "ab" * 32), ("2__0", "ab" * 32), ("2.0", "ab")], "v string, s string")
    made = [r[0] for r in df.select(scalars.snapshot_id(F.col("v"), F.to_date(F.lit("2024-05-06")), F.col("s"))).collect()]
    assert made == ["2.0__2024-05-06__abababababab", None, None]


def test_redaction_keeps_plain_words(spark):
    texts = ["see CC(=O)Oc1ccccc1C(=O)O now", "digest 0123456789abcdef0123 at 10:20", "plain words only", "path/to/some/file.txt"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.redact(F.col("t"))).collect()]
    assert got == ["see [REDACTED:structure sha256:56de9fefcf16] now", *texts[1:]]


def test_structure_stage(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, " "), (3, None), (4, "bad"), (5, "A.B")], "id int, s string")
    with pytest.raises(chemistry.ToolchainAbsent):
        chemistry.process_structures(df, "id", "s", None)

    def fake(s):
        if s == "bad":
            raise chemistry.StructureError("cannot be parsed")
        return {"key27": "K", "is_mixture": "." in s, "descriptors": [1.0], "bits": [1, 2]}

    got = {r.id: r for r in chemistry.process_structures(df, "id", "s", fake).collect()}
    assert got[1].error is None and got[1].descriptors == [1.0] and got[5].descriptors is None
    assert [got[i].error for i in (2, 3, 4)] == ["blank structure", "blank structure", "cannot be parsed"]
