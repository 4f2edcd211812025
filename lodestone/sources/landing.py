"""Landing of raw content: written once, and visible only with the digest that was expected.

Tasks write each object under a name of their attempt and digest what they write. The driver compares the digests
with the expected ones when all tasks have ended, and only then moves the objects to their keys and records them in
a manifest; a mismatch or a key that is there already leaves nothing new. A task that is tried again
writes under another name.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

ATTEMPTS, MANIFEST = "_attempts", "_landed"
#: Bytes that are read or written at a time.
CHUNK = 8 << 20


class LandingRefused(Exception):
    """A digest that differs from the expected one, a key that is there already, or a key outside the folder."""


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI as Spark writes it, with no escapes in its path, and the path there."""
    head, sep, tail = uri.partition(":/")
    if not sep:
        return fs.FileSystem.from_uri(uri)
    return fs.FileSystem.from_uri(f"file:///{quote(tail.lstrip('/'))}" if head == "file" else f"{head}:/{quote(tail, safe='/:@')}")


def _checked(key: str) -> str:
    if not key or key.startswith(("/", "_")) or any(p in ("", ".", "..") for p in key.split("/")):
        raise LandingRefused(f"{key!r} is no key of an object")
    return key


@dataclass
class Landed(WriterCommitMessage):
    """(key, attempt's path, digest, expected digest, bytes) of a task's objects."""

    objects: list[tuple[str, str, str, str | None, int]]


class LandingWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> Landed:
        """Rows (key, part, content, sha256), a key's together and in the order of their parts."""
        store, base = place(self.folder)
        attempt, objects, out, now = f"{base}/{ATTEMPTS}/{uuid.uuid4().hex}", [], None, None
        try:
            for key, _, content, expected in iterator:
                if key != now:
                    if out:
                        out.close()
                    now, digest, path = _checked(key), hashlib.sha256(), f"{attempt}/{len(objects)}"
                    store.create_dir(attempt, recursive=True)
                    out = store.open_output_stream(path)
                    objects.append([key, path, "", expected, 0])
                data = bytes(content or b"")
                digest.update(data)
                out.write(data)
                objects[-1][2], objects[-1][4] = digest.hexdigest(), objects[-1][4] + len(data)
        finally:
            if out:
                out.close()
        return Landed([tuple(o) for o in objects])

    def commit(self, messages: list) -> None:
        store, base = place(self.folder)
        objects = [o for m in messages if m for o in m.objects]
        wrong = sorted(f"{k}: {d} for {e}" for k, _, d, e, _ in objects if e is not None and d != e.lower())
        there = sorted(k for k, *_ in objects if store.get_file_info(f"{base}/{k}").type != fs.FileType.NotFound)
        if wrong or there:
            raise LandingRefused("; ".join([*(f"wrong content of {w}" for w in wrong[:5]), *(f"{k} has landed before" for k in there[:5])]))
        for key, path, *_ in objects:
            store.create_dir(f"{base}/{key}".rpartition("/")[0], recursive=True)
            store.move(path, f"{base}/{key}")
        store.create_dir(f"{base}/{MANIFEST}", recursive=True)
        with store.open_output_stream(f"{base}/{MANIFEST}/{uuid.uuid4().hex}.json") as out:
            for key, _, digest, _, size in objects:
                out.write((json.dumps({"key": key, "sha256": digest, "bytes": size}) + "\n").encode())
        self._clear(messages)

    def abort(self, messages: list) -> None:
        self._clear(messages)

    def _clear(self, messages: list) -> None:
        store, _ = place(self.folder)
        for folder in {o[1].rpartition("/")[0] for m in messages if m for o in m.objects}:
            if store.get_file_info(folder).type != fs.FileType.NotFound:
                store.delete_dir(folder)


class LandingSource(DataSource):
    """The sink `landing`, with the option path."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return "key string, part int, content binary, sha256 string"

    def writer(self, schema, overwrite: bool) -> LandingWriter:
        if overwrite:
            raise LandingRefused("what has landed isn't overwritten")
        return LandingWriter(self.options["path"])


def land(df: DataFrame, folder: str) -> None:
    """Writes objects: key, part (their order), content, and sha256, the digest expected of the whole object or null.
    An object's parts go through one task, a part at a time."""
    df.sparkSession.dataSource.register(LandingSource)
    rows = df.select("key", F.col("part").cast("int").alias("part"), "content", "sha256").repartition("key").sortWithinPartitions("key", "part")
    rows.write.format("landing").mode("append").option("path", folder).save()


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """key, sha256 and bytes of all that has landed."""
    return spark.read.schema("key string, sha256 string, bytes long").json(f"{folder.rstrip('/')}/{MANIFEST}")


def exists(folder: str, key: str) -> bool:
    store, base = place(folder)
    return store.get_file_info(f"{base}/{_checked(key)}").type == fs.FileType.File


def contents(objects: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """(key, part, content) of objects, a manifest's rows, in chunks that any task reads alone: no row holds an object
    of any size."""
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("bytes") - 1) / chunk)).cast("int"))
    spread = objects.select("key", F.explode(parts).alias("part")).repartition("key", "part")

    def run(batches):
        store, base = place(folder)
        for batch in batches:
            for key, part in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{base}/{key}") as f:
                    data = f.read_at(min(chunk, max(0, f.size() - part * chunk)), part * chunk)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["key", "part", "content"])

    return spread.mapInArrow(run, "key string, part int, content binary")


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and sha256 of every file under a folder; a task reads a file chunk by chunk."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")

    def run(batches):
        for batch in batches:
            paths, lengths = (c.to_pylist() for c in batch.columns)
            digests = []
            for path in paths:
                store, where = place(path)
                digest = hashlib.sha256()
                with store.open_input_stream(where) as f:
                    while data := f.read(CHUNK):
                        digest.update(data)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(lengths, pa.int64()), pa.array(digests)], names=["path", "length", "sha256"])

    return files.mapInArrow(run, "path string, length long, sha256 string")


def audited(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """(key, sha256, found, fault) of objects that aren't as recorded: missing, changed, or unrecorded.

    expected: key and sha256, in letters of either case; a recorded object without a digest has to be there, no more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    found = file_digests(spark, folder).select(F.substr("path", F.lit(len(root) + 2)).alias("key"), F.col("sha256").alias("found"))
    both = expected.select("key", F.lower("sha256").alias("sha256"), F.lit(True).alias("_recorded")).join(found, "key", "full")
    fault = F.when(F.col("_recorded").isNull(), "unrecorded").when(F.col("found").isNull(), "missing").when(F.col("sha256") != F.col("found"), "changed")
    return both.select("key", "sha256", "found", fault.alias("fault")).where("fault is not null")
