"""Readers, writers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import readers, writers
from lodestone.streaming import monitors


def test_screening_csv_skips_description_rows(spark, folder):
    with open(f"{folder}/a.csv", "w") as f:
        f.write("TAG,CID,Potency\nRESULT_TYPE,,FLOAT\nRESULT_DESCR,,text\n1,10,3.5\n2,11,n/a\n3,12,\n")
    got = readers.read_screening_csv(spark, f"{folder}/a.csv", ["TAG", "CID", "Potency"], "TAG", "Potency").orderBy("TAG").collect()
    assert [(r.TAG, r.Potency) for r in got] == [("1", 3.5), ("2", None), ("3", None)]


def test_usable_activities(spark):
    names = [c.split()[0] for c in readers.RAW_ACTIVITY.split(", ")]
    row = dict.fromkeys(names, "x") | {"standard_relation": "=", "standard_value": "5", "validity_comment": None}
    rows = [row, row | {"standard_relation": ">"}, row | {"validity_comment": "Outside typical range"}, row | {"validity_comment": ""}, row | {"structure": ""}, row | {"standard_value": None}]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], readers.RAW_ACTIVITY)
    assert readers.usable_activities(df, ("Outside typical range",)).count() == 2


def test_external_labels(spark):
    df = spark.createDataFrame([("Inconclusive", 1.0), ("Inactive", None), ("Active", 5.0), ("Active", 50.0), ("Active", None)], "o string, p double")
    assert [r[0] for r in df.select(readers.external_label(F.col("o"), F.col("p"), 10_000)).collect()] == [None, 0, 1, 0, None]


def test_registry_and_model_cards(spark, folder):
    with open(f"{folder}/r.yaml", "w") as f:
        f.write("sources:\n- source_id: a\n  license: {spdx: MIT, tier: green, commercial_ok: true, sharealike: partial}\n- source_id: b\n")
    rows = {r.source_id: r for r in readers.load_registry(spark, f"{folder}/r.yaml").collect()}
    assert rows["a"].sharealike is True and rows["b"].spdx is None
    with open(f"{folder}/r2.yaml", "w") as f:
        f.write("- x\n")
    with pytest.raises(ValueError):
        readers.load_registry(spark, f"{folder}/r2.yaml")
    for name, text in (("m", json.dumps({"model_id": "m", "version": "1"})), ("broken", "{")):
        with open(f"{folder}/{name}.json", "w") as f:
            f.write(text)
    assert [r.model_id for r in readers.read_model_registry(spark, folder).where("model_id is not null").collect()] == ["m"]


def test_paged_source(spark):
    def fetch(offset, limit):
        return [(i,) for i in range(offset, min(offset + limit, 25))]

    spark.dataSource.register(readers.paged_source("pages25", "id int", fetch, total=25, size=10))
    assert sorted(r.id for r in spark.read.format("pages25").load().collect()) == list(range(25))
    calls = []

    def flaky(offset, limit):
        calls.append(offset)
        if len(calls) < 3:
            raise ConnectionError
        return [(1,)]

    reader = readers.PagedReader(flaky, 1, 10, pause=0)
    assert list(reader.read(reader.partitions()[0])) == [(1,)] and len(calls) == 3


def test_write_once_and_digests(spark, folder):
    df = spark.range(10)
    writers.write_once(df, f"{folder}/t")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.write_once(df, f"{folder}/t")
    assert writers.back_up(spark, f"{folder}/t", f"{folder}/copy")
    found = readers.landed_digests(spark, f"{folder}/t").select("path", "sha256")
    assert readers.digest_mismatches(spark, f"{folder}/t", found).count() == 0
    assert readers.digest_mismatches(spark, f"{folder}/t", found.withColumn("sha256", F.lit("0"))).count() == found.count()


def test_append_absent_is_idempotent(spark, folder):
    assert [writers.append_absent(spark.range(n), f"{folder}/t", ["id"]) for n in (5, 5, 8)] == [5, 0, 3]
    assert spark.read.parquet(f"{folder}/t").count() == 8


def test_sorted_export(spark, folder):
    writers.write_sorted_csv(spark.range(100).select((99 - F.col("id")).alias("id")), f"{folder}/c", "id")
    import glob

    rows = [int(line) for p in sorted(glob.glob(f"{folder}/c/part-*")) for line in open(p).read().split()[1:]]
    assert rows == list(range(100))


def test_limiter_counts_only_accepted(spark):
    rows = [(i, "u", float(t)) for i, t in enumerate([0, 1, 2, 30, 61, 62, 63, 200])]
    df = spark.createDataFrame(rows, "id int, k string, t double").withColumn("ts", F.timestamp_seconds("t"))
    got = [r.accepted for r in monitors.rate_limit(df, "k", "ts", "id", limit=2, period=60).orderBy("id").collect()]
    assert got == [True, True, False, False, True, True, False, True]


def test_streams(spark, folder):
    rows = [(i, "u", float(i)) for i in range(6)]
    spark.createDataFrame(rows, "id int, k string, t double").withColumn("ts", F.timestamp_seconds("t")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("id int, k string, t double, ts timestamp").parquet(f"{folder}/in")
    limited = monitors.rate_limit_stream(stream, "k", "ts", "id", limit=4).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/c1").start()
    limited.awaitTermination(120)
    assert sorted((r.id, r.accepted) for r in spark.table("limited").collect()) == [(i, i < 4) for i in range(6)]
    seen = []
    q = monitors.upsert_stream(monitors.once(stream, "ts", ["k"], "1 hour"), lambda df, n: seen.extend(r.k for r in df.collect()), f"{folder}/c2")
    q.awaitTermination(120)
    assert seen == ["u"]
    w = monitors.tumbling(stream, "ts", "2 seconds", ["k"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{folder}/c3").start()
    w.awaitTermination(120)
    assert sorted(r.n for r in spark.table("w").collect()) == [2, 2, 2]
