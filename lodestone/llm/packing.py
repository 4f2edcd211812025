"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's full windows stand alone; its
remainder goes where it leaves the least room. Where it fits nowhere the fullest window is emitted,
after the head of the remainder has filled its gap if the gap is worth a cut. The windows left open
by neighbouring partitions are merged the same way, in rounds of a fixed fan-in, and those of the
last round are joined without gaps, so that one sequence at most is short.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize
from lodestone.llm.tokens import encoder, tokenizer_path

WINDOW = 2048
OPEN_WINDOWS = 64
#: Smaller gaps are padded rather than filled by the head of a document.
LEAST_CUT = 24
FAN_IN = 8
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "ids binary, open boolean, group long"
)


class OpenWindows:
    """Pieces are (doc_id, start, ids, doc_tokens). add() and close() yield emitted windows."""

    def __init__(self, window: int = WINDOW, limit: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT):
        self.window, self.limit, self.least_cut = window, limit, least_cut
        self.room: list[tuple[int, int]] = []  # (free, key), ascending
        self.held: dict[int, list] = {}
        self.next = 0

    def _put(self, key: int, free: int, piece: tuple) -> Iterator[list]:
        self.held.setdefault(key, []).append(piece)
        free -= len(piece[2])
        if free:
            insort(self.room, (free, key))
        else:
            yield self.held.pop(key)

    def add(self, doc, start: int, ids: np.ndarray, doc_tokens: int) -> Iterator[list]:
        while len(ids) >= self.window:
            yield [(doc, start, ids[: self.window], doc_tokens)]
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            at = bisect_left(self.room, (len(ids), -1))
            if at < len(self.room):
                free, key = self.room.pop(at)
                yield from self._put(key, free, (doc, start, ids, doc_tokens))
                return
            if len(self.room) < self.limit:
                self.next += 1
                yield from self._put(self.next, self.window, (doc, start, ids, doc_tokens))
                return
            free, key = self.room.pop(0)
            if free < self.least_cut or len(ids) - free < self.least_cut:
                yield self.held.pop(key)
            else:
                yield from self._put(key, free, (doc, start, ids[:free], doc_tokens))
                start, ids = start + free, ids[free:]

    def rest(self) -> list[list]:
        return [self.held[key] for _, key in self.room]


def joined(windows: list[list], window: int) -> Iterator[list]:
    """The windows' pieces end to end, cut at each full window."""
    now: list = []
    used = 0
    for doc, start, ids, doc_tokens in (p for w in windows for p in w):
        while len(ids):
            part = ids[: window - used]
            now.append((doc, start, part, doc_tokens))
            start, ids, used = start + len(part), ids[len(part) :], used + len(part)
            if used == window:
                yield now
                now, used = [], 0
    if now:
        yield now


class _Rows:
    """Rows of PIECES, given out in batches; sequence ids hold the round, the group and a counter."""

    def __init__(self, level: int, group: int, width: int):
        self.base, self.count, self.group, self.width = (level << 58) | (group << 30), 0, group, width
        self.rows: list[tuple] = []
        self.held = 0

    def put(self, window: list, left_open: bool = False) -> None:
        offset = 0
        for doc, start, ids, doc_tokens in window:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            data = ids.astype(f"<u{self.width}").tobytes()
            self.rows.append((doc, start, len(ids), crc, doc_tokens, self.base | self.count, offset, data, left_open, self.group))
            offset += len(ids)
            self.held += len(data)
        self.count += 1

    def batch(self) -> list[tuple]:
        rows, self.rows, self.held = self.rows, [], 0
        return rows


_NAMES = [c.split()[0] for c in PIECES.split(", ")]
_TYPES = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [_TYPES[c.split()[1]] for c in PIECES.split(", ")]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)


def _pack(batches, tokenizer: str, end_id: int, window: int, limit: int, least_cut: int):
    encode = encoder(tokenizer)
    windows = OpenWindows(window, limit, least_cut)
    rows = _Rows(0, TaskContext.get().partitionId(), 2 if max(encode.size - 1, end_id) < 1 << 16 else 4)
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            docs = part.column(0).to_pylist()
            for doc, ids in zip(docs, encode.encode_all(part.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id))
                for full in windows.add(doc, 0, ids, len(ids)):
                    rows.put(full)
                if rows.held > 4_000_000:
                    yield _arrow(rows.batch())
    for left in windows.rest():
        rows.put(left, True)
    yield _arrow(rows.batch())


def _merge(group: pd.DataFrame, level: int, fan_in: int, last: bool, window: int, limit: int, least_cut: int, width: int) -> pd.DataFrame:
    """The open windows of a group of partitions: the bounded algorithm again, fullest first."""
    left: dict[int, list] = {}
    for r in group.sort_values(["sequence_id", "offset"]).itertuples(index=False):
        ids = np.frombuffer(r.ids, f"<u{width}").astype(np.uint32)
        left.setdefault(r.sequence_id, []).append((None if pd.isna(r.doc_id) else int(r.doc_id), r.start, ids, r.doc_tokens))
    order = sorted(left.items(), key=lambda x: (-sum(len(p[2]) for p in x[1]), x[0]))
    rows = _Rows(level, int(group["group"].iloc[0]) // fan_in, width)
    if last:
        for full in joined([w for _, w in order], window):
            rows.put(full)
    else:
        windows = OpenWindows(window, limit, least_cut)
        for _, pieces in order:
            for piece in pieces:
                for full in windows.add(*piece):
                    rows.put(full)
        for w in windows.rest():
            rows.put(w, True)
    out = pd.DataFrame(rows.batch(), columns=_NAMES)
    return out.astype({"doc_id": "Int64"})


def _merger(*options):
    return lambda group: _merge(group, *options)


def pack_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    least_cut: int = LEAST_CUT,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Pieces of df's documents in sequences: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids (little-endian, two bytes an id where the vocabulary allows, else four).

    A null text counts as empty and is its end id alone; repeated rows are packed each; an empty
    table gives no pieces. No text is shuffled: a partition's own rows are encoded and packed.
    """
    from tokenizers import Tokenizer

    tokenizer = tokenizer or tokenizer_path()
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id) < 1 << 16 else 4
    run = lambda batches: _pack(batches, tokenizer, end_id, window, open_windows, least_cut)
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(texts.mapInArrow(run, PIECES), "pieces")
    done = [pieces.where("not open")]
    left = pieces.where("open")
    groups = (left.agg(F.max("group")).first()[0] or 0) + 1
    level = 0
    while True:
        level, last = level + 1, groups <= fan_in
        merge = _merger(level, fan_in, last, window, open_windows, least_cut, width)
        merged = left.groupBy(F.floor(F.col("group") / fan_in).alias("_to")).applyInPandas(merge, PIECES)
        if last:
            done.append(merged)
            break
        merged = materialize(merged, "merged")
        done.append(merged.where("not open"))
        left, groups = merged.where("open"), -(-groups // fan_in)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("open", "group")
