"""Token ids as fixed-width bit-packed files.

A shard holds documents in ascending order of their identifiers. Every id takes the least bits that
the vocabulary needs; ids are packed in blocks, and a table of block offsets at the end leads to any
document without reading the rest.

    header   magic "LDST", version u16, bits u16, ids in a block u32, reserved u32
    blocks   the ids, least significant bit first; each block starts at a byte
    tables   block offsets u64[blocks + 1], document ids i64[n], null flags u8[n], first ids u64[n + 1]
    trailer  blocks u64, documents u64, ids u64, place of the tables u64, magic "LDST"

Shards are written by tasks under a name of the attempt's own and renamed when whole, so a repeated
task replaces the shard by the same bytes. The folder may be of any scheme that pyarrow.fs opens.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize
from lodestone.llm.tokens import encoder, tokenizer_path

MAGIC, VERSION = b"LDST", 1
HEADER, TRAILER = struct.Struct("<4sHHII"), struct.Struct("<QQQQ4s")
BLOCK_IDS = 65_536
MANIFEST = "shard int, file string, documents long, ids long"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (spread.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1).astype(np.uint32)


class ShardWriter:
    """Packs ids into a binary stream as they come; holds one block and 17 bytes a document."""

    def __init__(self, stream, bits: int, block_ids: int = BLOCK_IDS):
        self.stream, self.bits, self.block_ids = stream, bits, block_ids
        stream.write(HEADER.pack(MAGIC, VERSION, bits, block_ids, 0))
        self.place, self.offsets = HEADER.size, [HEADER.size]
        self.held: list[np.ndarray] = []
        self.n_held = self.ids = 0
        self.names: list[int | None] = []
        self.firsts = [0]

    def add(self, name: int | None, ids: np.ndarray) -> None:
        self.names.append(name)
        self.ids += len(ids)
        self.firsts.append(self.ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            self._flush(self.n_held // self.block_ids * self.block_ids)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        for i in range(0, n, self.block_ids):
            data = pack(ids[i : min(i + self.block_ids, n)], self.bits)
            self.stream.write(data)
            self.place += len(data)
            self.offsets.append(self.place)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        if self.n_held:
            self._flush(self.n_held)
        names = np.array([x or 0 for x in self.names], "<i8")
        nulls = np.array([x is None for x in self.names], np.uint8)
        for table in (np.array(self.offsets, "<u8"), names, nulls, np.array(self.firsts, "<u8")):
            self.stream.write(table.tobytes())
        self.stream.write(TRAILER.pack(len(self.offsets) - 1, len(self.names), self.ids, self.place, MAGIC))


class Shard:
    """Reads a shard through a seekable binary file; ids(i, j) reads only the blocks they lie in."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        n_blocks, n, self.n_ids, tables, magic = TRAILER.unpack(self._at(size - TRAILER.size, TRAILER.size))
        head, version, self.bits, self.block_ids, _ = HEADER.unpack(self._at(0, HEADER.size))
        if magic != MAGIC or head != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        data = self._at(tables, 8 * (n_blocks + 1) + 9 * n + 8 * (n + 1))
        a, b, c = 8 * (n_blocks + 1), 8 * (n_blocks + 1) + 8 * n, 8 * (n_blocks + 1) + 9 * n
        self.offsets = np.frombuffer(data[:a], "<u8").astype(np.int64)
        self.names = np.frombuffer(data[a:b], "<i8")
        self.nulls = np.frombuffer(data[b:c], np.uint8)
        self.firsts = np.frombuffer(data[c:], "<u8").astype(np.int64)

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(int(place))
        return self.file.read(int(n))

    def ids(self, begin: int, end: int) -> np.ndarray:
        if begin >= end:
            return np.empty(0, np.uint32)
        first, last = begin // self.block_ids, (end - 1) // self.block_ids
        data = self._at(self.offsets[first], self.offsets[last + 1] - self.offsets[first])
        sizes = [min(self.block_ids, self.n_ids - k * self.block_ids) for k in range(first, last + 1)]
        cuts = self.offsets[first : last + 2] - self.offsets[first]
        parts = [unpack(data[cuts[k] : cuts[k + 1]], n, self.bits) for k, n in enumerate(sizes)]
        return np.concatenate(parts)[begin - first * self.block_ids : end - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.firsts[i]), int(self.firsts[i + 1]))

    def documents(self, run: int = 4_000_000) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(identifier, first id, ids) of each document, about `run` ids read at a time."""
        i, n = 0, len(self.names)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.firsts, self.firsts[i] + run, "right")) - 1)
            ids = self.ids(int(self.firsts[i]), int(self.firsts[j]))
            for k in range(i, j):
                a, b = self.firsts[k] - self.firsts[i], self.firsts[k + 1] - self.firsts[i]
                yield (None if self.nulls[k] else int(self.names[k])), int(self.firsts[k]), ids[a:b]
            i = j


def _write(batches, folder: str, tokenizer: str, end_id: int, block_ids: int):
    from pyarrow import fs

    encode = encoder(tokenizer)
    shard, writer = TaskContext.get().partitionId(), None
    store, base = fs.FileSystem.from_uri(folder)
    name = f"{base}/shard-{shard:06d}.bin"
    own = f"{base}/.{shard:06d}-{uuid.uuid4().hex}"
    stream = None
    for batch in batches:
        if writer is None and batch.num_rows:
            store.create_dir(base, recursive=True)
            stream = store.open_output_stream(own)
            writer = ShardWriter(stream, bits_for(encode.size), block_ids)
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            names = part.column(0).to_pylist()
            for name_, ids in zip(names, encode.encode_all(part.column(1).to_pylist())):
                writer.add(name_, np.append(ids, np.uint32(end_id)))
    if writer is not None:
        writer.close()
        stream.close()
        store.move(own, name)
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "file": [f"shard-{shard:06d}.bin"], "documents": [len(writer.names)], "ids": [writer.ids]}
        )


def _drop_attempts(folder: str) -> None:
    """Shards that attempts of lost or failed tasks have left unnamed."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    for file in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if file.base_name.startswith("."):
            store.delete_file(file.path)


#: So many first characters of a text tell ranges apart behind an identifier.
HEAD = 200


def write_tokens(
    df: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 0,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Encode df's texts into shards under `folder`; returns the manifest with each shard's first id.

    One shard for each range of identifiers (spark.sql.shuffle.partitions ranges, joined where they
    are small). Null texts count as empty and hold the end id alone; null identifiers come first;
    rows that share an identifier follow one another by text, and lie in several shards where they are many (texts alike in their
    first HEAD characters lie in one). An empty table makes no shard.
    """
    tokenizer = tokenizer or tokenizer_path()
    ordered = (
        df.select(F.col(id_col).cast("long").alias("_id"), F.substring(F.col(text_col), 1, HEAD).alias("_head"), F.col(text_col).alias("_text"))
        .repartitionByRange("_id", "_head")
        .sortWithinPartitions("_id", "_head", "_text")
        .select("_id", "_text")
    )
    write = lambda batches: _write(batches, folder, tokenizer, end_id, block_ids)
    manifest = materialize(ordered.mapInArrow(write, MANIFEST), "manifest")
    _drop_attempts(folder)
    # One row a shard: the only thing that is summed in order.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0))).withColumn(
        "file", F.concat(F.lit(folder.rstrip("/") + "/"), "file")
    )


def _read(batches):
    from pyarrow import fs

    for batch in batches:
        for row in batch.to_pylist():
            store, path = fs.FileSystem.from_uri(row["file"])
            with store.open_input_file(path) as file:
                rows: list[tuple] = []
                for name, first, ids in Shard(file).documents():
                    rows.append((name, row["first"] + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) >= 10_000:
                        yield _digests(rows)
                        rows = []
                yield _digests(rows)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"]
    )


def read_digests(manifest: DataFrame) -> DataFrame:
    """Per document in the shards: doc_id, start, n_tokens, ids_crc32, from the files' own bytes."""
    n = max(1, manifest.count())
    spread = manifest.select("shard", "file", "first").repartitionByRange(n, "shard")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
