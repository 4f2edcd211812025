"""Landing by digest, a paged service of unknown length, and change capture across restarts."""

import hashlib
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.sources import landing, service
from lodestone.streaming import changes

SCHEMA = "key string, part int, content binary, sha256 string"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def objects(*items, chunk=5):
    """Rows of (key, content, expected digest or True for the right one)."""
    rows = []
    for key, data, expected in items:
        parts = [data[i : i + chunk] for i in range(0, len(data), chunk)] or [b""]
        rows += [(key, i, bytearray(p), sha(data) if expected is True else expected) for i, p in enumerate(parts)]
    random.Random(1).shuffle(rows)
    return rows


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if "_landed" not in d)


def test_landing_publishes_what_has_the_right_digest(spark, folder):
    where = f"file://{folder}/zone"
    big = bytes(range(256)) * 40
    landing.land(spark.createDataFrame(objects(("green/a/1.csv", b"one two three four", True), ("b.bin", big, sha(big).upper()), ("empty", b"", None)), SCHEMA), where)
    assert files(f"{folder}/zone") == ["b.bin", "empty", "green/a/1.csv"]
    found = {r.key: (r.sha256, r["bytes"]) for r in landing.manifest(spark, where).collect()}
    assert found == {"green/a/1.csv": (sha(b"one two three four"), 18), "b.bin": (sha(big), len(big)), "empty": (sha(b""), 0)}
    assert landing.exists(where, "b.bin") and not landing.exists(where, "c.bin")
    rows = sorted((r.key, r.part, bytes(r.content)) for r in landing.contents(landing.manifest(spark, where), where, 1_000).collect())
    assert b"".join(c for k, _, c in rows if k == "b.bin") == big and len([1 for k, *_ in rows if k == "b.bin"]) == 11 and ("empty", 0, b"") in rows
    assert {(r.path.rsplit("/", 1)[1], r.sha256, r.length) for r in landing.file_digests(spark, f"{folder}/zone/green").collect()} == {("1.csv", sha(b"one two three four"), 18)}


def test_wrong_digests_and_second_writes_leave_nothing(spark, folder):
    where = f"file://{folder}/zone"
    with pytest.raises(PySparkException, match="wrong content of bad"):
        landing.land(spark.createDataFrame(objects(("good", b"fine", True), ("bad", b"changed", sha(b"original"))), SCHEMA), where)
    assert files(f"{folder}/zone") == []
    landing.land(spark.createDataFrame(objects(("good", b"fine", True)), SCHEMA), where)
    with pytest.raises(PySparkException, match="good has landed before"):
        landing.land(spark.createDataFrame(objects(("good", b"other", True), ("new", b"x", True)), SCHEMA), where)
    assert files(f"{folder}/zone") == ["good"] and open(f"{folder}/zone/good", "rb").read() == b"fine"
    with pytest.raises(PySparkException, match="no key of an object"):
        landing.land(spark.createDataFrame(objects(("../out", b"x", None)), SCHEMA), where)


def test_a_task_tried_again_costs_no_object(folder):
    """The first attempt dies halfway; the second's message is the one that is committed."""
    writer = landing.LandingWriter(f"file://{folder}/zone")

    def dies():
        yield ("a", 0, b"half", None)
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(dies())
    writer.commit([writer.write(iter([("a", 0, b"half", None), ("a", 1, b" whole", sha(b"half whole"))])), None])
    assert open(f"{folder}/zone/a", "rb").read() == b"half whole"
    with pytest.raises(landing.LandingRefused):
        writer.commit([writer.write(iter([("a", 0, b"again", None)]))])


class Shelf:
    """A service over a list of rows that counts requests and can fail."""

    def __init__(self, n, failing=()):
        self.n, self.failing, self.asked = n, set(failing), []

    def __call__(self, offset, limit):
        self.asked.append(offset)
        if len(self.asked) in self.failing:
            raise service.Unavailable("503")
        return [(i,) for i in range(offset, min(offset + limit, self.n))], offset + limit < self.n


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 20, 73, 640, 641])
def test_length_is_found_by_doubling_and_halving(n):
    shelf = Shelf(n)
    assert service.Asking(shelf, size=10, pause=0).length() == n
    assert len(shelf.asked) <= 2 * max(1, n // 10).bit_length() + 3


@pytest.mark.parametrize("n,pages_each", [(0, 2), (57, 1), (60, 2), (401, 7)])
def test_every_row_once_though_the_service_fails(n, pages_each):
    shelf = Shelf(n, failing=range(2, 900, 3))
    reader = service.ServiceReader(service.Asking(shelf, size=10, pause=0), pages_each)
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == list(range(n))
    gone = service.ServiceReader(service.Asking(Shelf(5, failing=range(1, 99)), pause=0, tries=3), 1)
    with pytest.raises(service.Unavailable):
        gone.partitions()


def test_a_service_that_grows_or_shrinks_meanwhile():
    shelf = Shelf(55)
    reader = service.ServiceReader(service.Asking(shelf, size=10, pause=0), 2)
    parts = reader.partitions()
    shelf.n = 95
    assert [r[0] for p in parts for r in reader.read(p)] == list(range(95))
    shelf.n = 33
    assert [r[0] for p in parts for r in reader.read(p)] == list(range(33))
    stream = service.ServiceStream(service.Asking(shelf, size=10, pause=0), 2)
    assert stream.latestOffset() == {"rows": 33}
    shelf.n = 12
    assert stream.latestOffset() == {"rows": 33}
    assert [r[0] for p in stream.partitions({"rows": 5}, {"rows": 33}) for r in stream.read(p)] == list(range(5, 12))


def test_service_as_batch_and_stream(spark, folder):
    have = f"{folder}/have"

    def fetch(offset, limit):
        n = int(open(have).read())
        return [(i, f"r{i}") for i in range(offset, min(offset + limit, n))], offset + limit < n

    spark.dataSource.register(service.service_source("shelf", "id int, name string", fetch, size=7, pages_each=2, pause=0))
    got = []
    for n in (0, 30, 52):
        with open(have, "w") as f:
            f.write(str(n))
        assert spark.read.format("shelf").load().count() == n
        query = spark.readStream.format("shelf").load().writeStream.foreachBatch(lambda df, i: got.extend(r.id for r in df.collect())).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        assert sorted(got) == list(range(n))


def plain_changes(messages):
    """Messages in their order of arrival, one batch."""
    last, seen, out = {}, set(), []
    for k, s, v, gone in sorted(messages, key=lambda m: m[1]):
        if (k, s, v, gone) in seen:
            continue
        seen.add((k, s, v, gone))
        old = last.get(k)
        kind = "insert" if old is None else ("soft_delete" if gone else "restore") if gone != old[1] else "update" if v != old[0] else None
        if kind:
            out.append((k, s, kind))
        last[k] = (v, gone)
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 4])
def test_changes_in_one_batch_and_in_four_across_a_restart(spark, folder, batches):
    rng = random.Random(6)
    messages, deleted = [], set()
    for s in range(60):
        k = rng.choice("abcd")
        deleted ^= {k} if rng.random() < 0.3 else set()
        messages.append((k, s, rng.randint(0, 2), k in deleted))
    sent = list(messages)
    for at in sorted(rng.sample(range(60), 15), reverse=True):
        sent.insert(min(len(sent), at + rng.randint(1, 20)), messages[at])  # repeats, later
    spark.conf.set(*changes.STATE_STORE)
    size, got = -(-len(sent) // batches), []
    schema = "k string, s long, v int, gone boolean"
    for i in range(0, len(sent), size):
        spark.createDataFrame(sent[i : i + size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = changes.change_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), "k", "s", ["v"], "gone", None if batches == 1 else changes.DAY)
        query = stream.writeStream.foreachBatch(lambda df, _: got.extend((r.key, r.seq, r.operation) for r in df.collect())).option("checkpointLocation", f"{folder}/state").trigger(**({"availableNow": True} if batches == 1 else {"once": True})).start()
        assert query.awaitTermination(100)  # each start is a restart from the checkpoint
    assert sorted(got) == plain_changes(messages) and {g[2] for g in got} == {"insert", "update", "soft_delete", "restore"}
