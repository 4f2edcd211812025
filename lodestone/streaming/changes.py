"""Change capture and idempotent ingest as one stateful stream.

Per key the state holds the last row, for as long as the key exists, and the digests of messages seen, each for
a time to live: a repeat within it changes nothing. State lies in RocksDB and its checkpoint, so a restart goes on
with it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that stateful processors need, as a session setting.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAY = 86_400_000
CHANGES = "key string, seq long, operation string, old_values string, new_values string"


class Changes(StatefulProcessor):
    """Messages of a key, by seq, to changes: insert, update, soft_delete, restore; what changes nothing gives none."""

    def __init__(self, seen_ms: int | None = DAY):
        self.seen_ms = seen_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "content string, deleted boolean, seq long")
        self.seen = handle.getMapState("seen", "digest string", "seq long", *([self.seen_ms] if self.seen_ms else []))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.last.get() if self.last.exists() else None
        for r in sorted(rows, key=lambda r: (r["_seq"], r["_digest"])):
            if self.seen.containsKey((r["_digest"],)):
                continue
            self.seen.updateValue((r["_digest"],), (r["_seq"],))
            if old is not None and r["_seq"] < old[2]:
                continue  # older than what the key is now
            if old is None:
                operation = "insert"
            elif bool(r["_deleted"]) != bool(old[1]):
                operation = "soft_delete" if r["_deleted"] else "restore"
            else:
                operation = "update" if r["_content"] != old[0] else None
            if operation:
                yield Row(key=key[0], seq=r["_seq"], operation=operation, old_values=old[0] if old else None, new_values=r["_content"])
            old = (r["_content"], bool(r["_deleted"]), r["_seq"])
            self.last.update(old)

    def close(self) -> None:
        pass


def change_stream(df: DataFrame, key: str, seq: str, columns: list[str], deleted: str, seen_ms: int | None = DAY) -> DataFrame:
    """The changes that a stream of messages makes, as CHANGES; the session uses STATE_STORE.

    A message is a key's columns as of seq, and whether the key is deleted. Messages alike in all of them are
    repeats. Messages of a micro-batch go by seq; one older than its key's last is dropped. Null keys are a key
    of their own, null flags mean not deleted.
    Digests that expire do so by processing time, for which there is always another batch: such a stream needs a
    trigger by time or of one batch, not availableNow. With seen_ms None they are kept for good.
    """
    content = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows = df.select(
        F.col(key).cast("string").alias("_key"), F.col(seq).cast("long").alias("_seq"), content.alias("_content"), F.coalesce(F.col(deleted), F.lit(False)).alias("_deleted"),
    ).withColumn("_digest", F.sha2(F.concat_ws("|", F.col("_seq").cast("string"), F.col("_deleted").cast("string"), F.col("_content")), 256))
    return rows.groupBy("_key").transformWithState(Changes(seen_ms), CHANGES, "Append", "ProcessingTime" if seen_ms else "None")
