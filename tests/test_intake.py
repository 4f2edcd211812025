"""Raw activities, external labels, registries, landed objects, runs and reports on small tables."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.catalog import load
from lodestone.functions import scalars
from lodestone.operators import constraints, profile, selection
from lodestone.plans import flows
from lodestone.sources import landing, readers

SMALL = "/root/testdata/sf0.001"


def test_faults_of_activities_in_their_order(spark):
    columns = "id int, molecule_id string, structure string, standard_value string, standard_relation string, validity_comment string"
    rows = [
        (1, "m", "C", "1", "=", None), (2, "m", "C", "1", "=", ""), (3, "m", "C", "1", "=", "Manually validated"), (4, "m", "C", "1", "=", "bad"), (5, "m", "C", "1", "<", "bad"),
        (6, "m", "C", "1", None, None), (7, "m", "C", "", "<", None), (8, "m", "C", None, "=", None), (9, "m", "", "1", "=", None), (10, None, None, None, None, None), (11, "", "C", "1", "=", None),
    ]
    df = spark.createDataFrame(rows, columns)
    assert {r.id for r in readers.usable_activities(df, ("bad",)).collect()} == {1, 2, 3}
    drops = {r.fault: r.n for r in readers.activity_drops(df, ("bad",)).collect()}
    assert drops == {"flagged": 1, "censored": 2, "no_value": 2, "no_structure": 1, "no_molecule": 2}
    assert readers.usable_activities(df, ("bad",)).count() + sum(drops.values()) == len(rows)
    assert readers.activity_drops(df.limit(0), ("bad",)).count() == 0


def test_external_rows_lose_none(spark):
    df = spark.createDataFrame([("Inconclusive", 1.0), ("Inactive", None), ("Inactive", 9.0), ("Active", 11.0), ("Active", None), (None, 10.0), (None, None)], "o string, p double")
    labelled, dropped = readers.external_rows(df, "o", "p", 10_000)
    assert sorted((r.o or "", r.p or 0, r.label) for r in labelled.collect()) == [("", 10.0, 1), ("Active", 11.0, 0), ("Inactive", 0, 0), ("Inactive", 9.0, 1)]
    assert {r.o: r.n for r in dropped.collect()} == {"Inconclusive": 1, "Active": 1, None: 1}


def test_audit_of_landed_objects(spark, folder):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = spark.createDataFrame([(k, 0, bytearray(k.encode()), sha(k)) for k in ("a/1", "a/2 b", "c", "d%20e")], "key string, part int, content binary, sha256 string")
    landing.land(rows, f"file://{folder}/zone")
    recorded = [("a/1", sha("a/1").upper()), ("a/2 b", sha("other")), ("gone", sha("gone")), ("c", None)]
    expected = spark.createDataFrame(recorded, "key string, sha256 string")
    got = {r.key: (r.fault, r.sha256, r.found) for r in landing.audited(spark, f"file://{folder}/zone", expected).collect()}
    assert got == {"a/2 b": ("changed", sha("other"), sha("a/2 b")), "gone": ("missing", sha("gone"), None), "d%20e": ("unrecorded", None, sha("d%20e"))}
    assert {r.fault for r in landing.audited(spark, f"file://{folder}/zone", expected.limit(0)).collect()} == {"unrecorded"}


def test_status_of_runs_and_their_rules(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [
        (1, "started", day(1), None, None), (1, "completed", day(2), 5, 5), (2, "started", day(3), None, None), (2, "completed", day(2), 5, 6),
        (3, "started", day(1), None, None), (3, "failed", day(4), None, None), (4, "started", day(1), None, None), (1, "completed", day(2), 5, 5), (5, "completed", day(1), None, 2),
    ]
    status = flows.run_status(spark.createDataFrame(rows, "run_id int, state string, at timestamp, parsed long, imported long"))
    got = {r.run_id: (r.state, r.started_at, r.completed_at, r.parsed, r.imported) for r in status.collect()}
    assert got == {
        1: ("completed", day(1), day(2), 5, 5), 2: ("started", day(3), day(2), 5, 6), 3: ("failed", day(1), None, None, None), 4: ("started", day(1), None, None, None), 5: ("completed", None, day(1), None, 2),
    }
    c = F.col
    rules = constraints.run_rules(c("started_at"), c("completed_at"), c("state").isin("completed", "failed"), c("parsed"), c("imported"))
    broken = {(r.rule, r.key) for r in constraints.violations(status, "run_id", rules).collect()}
    assert broken == {("completed_after_start", "2"), ("imported_within_parsed", "2"), ("terminal_is_completed", "3")}


def test_pairs_need_equal_lengths(spark):
    df = spark.createDataFrame([([1, 2], ["a", None]), ([], [])], "x array<int>, y array<string>")
    assert [[tuple(p) for p in r[0]] for r in df.select(selection.paired(F.col("x"), F.col("y"))).collect()] == [[(1, "a"), (2, None)], []]
    for bad in (([1], ["a", "b"]), (None, ["a"]), (None, None)):
        with pytest.raises(Exception, match="unequal length"):
            spark.createDataFrame([bad], "x array<int>, y array<string>").select(selection.paired(F.col("x"), F.col("y"))).collect()


def test_identifiers_are_null_or_an_error_where_a_part_is_wrong(spark):
    sha, day = "0123456789abcdef", dt.date(2024, 2, 29)
    c = F.col
    made = lambda rows, strict: [tuple(r) for r in spark.createDataFrame(rows, "v string, d date, s string, f string").select(
        scalars.snapshot_id(c("v"), c("d"), c("s"), strict), scalars.landing_key(F.lit("green"), c("v"), c("s"), c("f"), strict)).collect()]
    good = ("r_1", day, sha, "a.csv")
    assert made([good], True) == made([good], False) == [("r_1__2024-02-29__0123456789ab", f"green/r_1/{sha}/a.csv")]
    wrong = [("r__1", day, sha, "a"), ("r", day, "0123", "a"), ("r", None, sha, "a"), (None, day, sha, "a"), ("r", day, sha, "a/b"), ("r", day, sha, ""), ("r", day, sha, None)]
    assert all(None in r for r in made(wrong, False))
    for row in wrong:
        with pytest.raises(Exception, match="not the parts of a"):
            made([row], True)


def test_report_has_a_line_for_each_row_set_aside(spark):
    rows = [(1, None, ["salt"], 1.25, "g"), (2, None, [], 2.5, "g"), (3, "bad", ["salt"], 99.0, "g"), (4, None, None, None, None), (5, None, ["salt", "mix"], 3.0, "h"), (None, "worse", [], 1.0, "h")]
    df = spark.createDataFrame(rows, "id int, error string, flags array<string>, mass double, key string")
    report = lambda x: [tuple(r) for r in profile.quality_report(x, "id", "error", "flags", ["mix", "salt"], ["mass"], "key").orderBy("section", "item").collect()]
    assert report(df) == [
        (1, "1", "- Records attempted: 6"), (1, "2", "- Processed: 4"), (1, "3", "- Quarantined: 2"), (2, "-", "| - | worse |"), (2, "3", "| 3 | bad |"), (3, "mix", "- mix: 1"), (3, "salt", "- salt: 3"),
        (4, "g", "- `g`: 2 records, first 1"), (5, "mass", "- mass: mean 2.3, min 1.3, max 3.0"),
    ]
    assert [r[2] for r in report(df.limit(0))] == ["- Records attempted: 0", "- Processed: 0", "- Quarantined: 0", "- mix: 0", "- salt: 0", "- mass: none"]


def test_queries_show_every_fault(spark):
    found = load()[0]
    kinds = lambda name, column: {r[0] for r in found[name](spark, SMALL).select(column).distinct().collect()}
    assert kinds("landing_audit", "fault") == {"missing", "changed", "unrecorded"}
    assert kinds("run_constraints", "rule") == {"completed_after_start", "terminal_is_completed", "imported_within_parsed"}
    assert kinds("activity_drops", "fault") == {"flagged", "censored", "no_value", "no_structure", "no_molecule"}
    assert kinds("snapshot_log", "batch") == {1, 2}
