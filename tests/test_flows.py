"""Gates, synchronisation, exports, row picks and model checks against plain Python."""

import hashlib
import io
import json
import random
import urllib.error
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import governance, ml, selection
from lodestone.sources import readers, writers
from lodestone.streaming import monitors


def test_sync_refuses_licence_changes_until_acknowledged(spark):
    schema = "id string, spdx string, name string, extra string"
    existing = spark.createDataFrame([("a", "MIT", "A", "x"), ("b", "MIT", "B", "y"), ("c", None, "C", "z")], schema)
    registry = spark.createDataFrame([("a", "GPL", "A2"), ("b", "MIT", "B2"), ("d", "CC0", "D")], "id string, spdx string, name string")
    with pytest.raises(governance.LicenseChange, match="a"):
        governance.apply_sync(registry, existing, "id", ["spdx"], ["name"])
    got = governance.apply_sync(registry, existing, "id", ["spdx"], ["name"], acknowledged=True)
    assert sorted(map(tuple, got.collect())) == [("a", "MIT", "A", "x"), ("b", "MIT", "B2", "y"), ("c", None, "C", "z"), ("d", "CC0", "D", None)]
    assert governance.known_sources(existing, existing, "id") is existing
    with pytest.raises(ValueError, match="d"):
        governance.known_sources(registry, existing, "id")


REGISTRY = """
sources:
- source_id: plain
  license: {spdx: CC0-1.0, tier: green, commercial_ok: true, sharealike: false}
- source_id: wrong
  license: {spdx: CC-BY-4.0, tier: green, commercial_ok: false, sharealike: partial}
- source_id: split
  license: {spdx: MIXED, tier: mixed, split_licensing: [{portion: own, spdx: CC-BY-3.0, tier: amber, attribution: t}, {portion: other, spdx: NEW, tier: red}]}
- source_id: carved
  license: {spdx: MIXED, tier: mixed, default_spdx: CC-BY-4.0, default_tier: amber, attribution: t, exclusions: [{dataset: f, tier: red, commercial_ok: true}]}
- source_id: mixed
  license: {spdx: MIXED, tier: mixed}
- source_id: none
- source_id: stale
  license: {tier: green}
  cadence: {stale: true}
  verification: {status: unverified}
excluded_sources:
- source_id: out
  license: {tier: black, commercial_ok: true}
"""


def test_licence_rules_on_a_registry(spark, folder):
    with open(f"{folder}/r.yaml", "w") as f:
        f.write(REGISTRY)
    got = governance.license_audit(readers.load_license_blocks(spark, f"{folder}/r.yaml"))
    assert sorted((r.source_id, r.context, r.rule, r.finding) for r in got.collect()) == sorted([
        ("wrong", "", "LC-02", "tier_contradicts_identifier"), ("wrong", "", "LC-03", "commercial_flag_contradicts_tier"), ("wrong", "", "LC-02", "sharealike_contradicts_identifier"),
        ("wrong", "", "LC-05", "attribution_missing"), ("split", "other", "LC-02", "unknown_identifier"), ("carved", "f", "LC-03", "exclusion_not_black"),
        ("carved", "f", "LC-03", "exclusion_commercial"), ("mixed", "", "LC-01", "mixed_without_portions"), ("none", "", "LC-01", "no_license"),
        ("stale", "", "LC-01", "missing_identifier"), ("stale", "", "LC-04", "stale"), ("stale", "", "figures", "unverified"),
        ("out", "", "LC-06", "excluded_is_commercial"), ("out", "", "LC-06", "excluded_without_reason"),
    ])


def test_artifacts_are_verified_before_they_load(spark, folder):
    expected = {}
    for name in ("model.bin", "scaler.bin"):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(name.encode())
        expected[name] = hashlib.sha256(name.encode()).hexdigest()
    assert readers.verified(spark, folder, expected) == folder
    with pytest.raises(readers.DigestMismatch, match="model.bin: other content; none.bin: missing"):
        readers.verified(spark, folder, {"model.bin": "0" * 64, "none.bin": "0" * 64})


def test_download(folder):
    data, calls = b"x" * 100_000, []

    def server(*answers):
        it = iter(answers)

        def open_url(url):
            calls.append(url)
            a = next(it)
            if isinstance(a, int):
                raise urllib.error.HTTPError(url, a, "", {}, None)
            if isinstance(a, Exception):
                raise a
            return io.BytesIO(a)

        return open_url

    sha, path = hashlib.sha256(data).hexdigest(), f"{folder}/f"
    assert readers.download("u", path, sha, server(503, ConnectionError(), 429, data), pause=0) == len(data)
    with open(path, "rb") as f:
        assert f.read() == data
    calls.clear()
    with pytest.raises(readers.Refused):
        readers.download("u", path, sha, server(404, data), pause=0)
    assert len(calls) == 1
    assert readers.download("u", path, sha, server(b"bad", b"worse", data), pause=0) == len(data)
    with pytest.raises(readers.DigestMismatch):
        readers.download("u", path, sha, server(b"a", b"b", b"c"), pause=0)
    with pytest.raises(ConnectionError):
        readers.download("u", path, sha, server(500, 500, 500, 500), pause=0)


def test_rows_that_must_match(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert selection.must_match(left, spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, w int"), ["k"]).count() == 3
    for rows in ([(1, 10)], [(1, 10), (2, 20), (2, 21)]):
        with pytest.raises(ValueError):
            selection.must_match(left, spark.createDataFrame(rows, "k int, w int"), ["k"])


def test_row_at_a_fraction(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1.0, 2.0, 2.5, None])) for i in range(83)]
    df = spark.createDataFrame(rows, "id int, v double")
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    for fraction in (0.0, 0.05, 0.5, 0.99, 1.0):
        got = selection.row_at_fraction(df, "v", "id", fraction).first()
        assert (got.id, got.v) == ordered[min(int(83 * fraction), 82)]
    assert selection.row_at_fraction(df.limit(0), "v", "id", 0.5).count() == 0


def test_golden_json_and_csv_lines(spark):
    df = spark.createDataFrame([(1, 0.1234567891, [(2.00000049, {"k": 1 / 3})], None)], "b int, a double, z array<struct<y:double,m:map<string,double>>>, n struct<q:double>")
    assert json.loads(writers.export_json(df).first()[0]) == {"a": 0.123457, "b": 1, "z": [{"m": {"k": 0.333333}, "y": 2.0}]}
    rows = spark.createDataFrame([('say "hi"', "a,b", ["x", "y"], None), ("line\nbreak", "plain", [], 3)], "a string, b string, c array<string>, d int")
    assert [r[0] for r in rows.select(writers.csv_line(rows)).collect()] == ['"say ""hi""","a,b",x|y,', '"line\nbreak",plain,,3']


def test_rate_limit_as_in_plain_python(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "c", None]), round(rng.random() * 300, 2)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, k string, s double").withColumn("ts", F.timestamp_seconds("s")).repartition(5)
    got = {r.id: r.accepted for r in monitors.rate_limit(df, "k", "ts", "id", limit=4, period=10.0).collect()}
    by_key, want = defaultdict(list), {}
    for i, k, s in sorted(rows, key=lambda r: (r[2], r[0])):
        t = round(s * 1e6) / 1e6
        taken = [x for x in by_key[k] if x >= t - 10.0]
        want[i] = len(taken) < 4
        if want[i]:
            by_key[k].append(t)
    assert got == want


def test_nested_redaction(spark):
    from lodestone.functions import scalars

    df = spark.createDataFrame([("CCO", ("c1ccccc1O", 5, None), ["see c1ccccc1O now"], {"SMILES": "CC", "note": "C=CC=C ok"})], "Smiles string, inner struct<mol:string,n:int,inchi:string>, texts array<string>, tags map<string,string>")
    mark = lambda t: f"[REDACTED:structure sha256:{hashlib.sha256(t.encode()).hexdigest()[:12]}]"
    r = scalars.redacted_events(df).first()
    assert (r.Smiles, r.inner.mol, r.inner.n, r.inner.inchi) == (mark("CCO"), mark("c1ccccc1O"), 5, "[REDACTED:structure]")
    assert r.texts == [f"see {mark('c1ccccc1O')} now"] and r.tags == {"SMILES": mark("CC"), "note": f"{mark('C=CC=C')} ok"}


def test_stratified_split_and_resampling(spark):
    df = spark.range(2000).withColumn("y", (F.col("id") % 5 == 0).cast("int")).withColumn("weight", F.lit(2.0))
    train, test = ml.stratified_split(df, "id", "y", 0.25)
    assert train.count() + test.count() == 2000 and train.join(test, "id").count() == 0
    assert {r.y: r["count"] for r in test.groupBy("y").count().collect()} == pytest.approx({0: 400, 1: 100}, abs=2)
    n = df.select(ml.drawn("id", 1).alias("n")).agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    assert abs(n[0] - 2000) < 150 and abs(n[1] - 2000 * (1 - np.exp(-1))) < 100


def test_mahalanobis(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 2.0]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id int, v array<double>")
    got = {r.id: r.mahalanobis for r in ml.mahalanobis(df, df, "v").collect()}
    off = x - x.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", off, np.linalg.inv(np.cov(x.T)), off))
    assert got[999] is None and all(got[i] == pytest.approx(want[i], rel=1e-3) for i in range(300))


def test_scrambled_labels_keep_their_numbers(spark, monkeypatch):
    monkeypatch.setattr(ml, "RANGE_ROWS", 60)
    df = spark.range(1000).withColumn("y", (F.col("id") % 3).cast("int"))
    at = ml.positions(df, F.xxhash64("id"), "id").select("_position").collect()
    assert sorted(r[0] for r in at) == list(range(1000))
    rows = ml.permuted_labels(df, "id", "y", 3).collect()
    for r in range(3):
        got = {x.id: x[f"y_{r}"] for x in rows}
        assert sorted(got.values()) == sorted(i % 3 for i in range(1000)) and 200 < sum(got[i] == i % 3 for i in got) < 470
    assert len({(x.y_0, x.y_1, x.y_2) for x in rows}) == 27
