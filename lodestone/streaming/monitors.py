"""Streams of requests: windows, the accepting rate limiter, idempotent ingest, audited upserts.

The window functions take batch and streaming frames alike.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT, PERIOD = 30, 60


def tumbling(df: DataFrame, ts: str, length: str, keys: list[str], lateness: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts, and value sums, by window and keys; with lateness as a watermark on streams."""
    df = df.withWatermark(ts, lateness) if lateness else df
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(df: DataFrame, ts: str, gap: str, key: str, lateness: str | None = None) -> DataFrame:
    df = df.withWatermark(ts, lateness) if lateness else df
    return df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def outcome_rates(df: DataFrame, ts: str, length: str, rejected: Column) -> DataFrame:
    """Rows and share of rejections by window."""
    return df.groupBy(F.window(ts, length).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(rejected).alias("rejected")).select(
        F.col("w.start").alias("start"), "n", "rejected"
    )


def sliding_count(df: DataFrame, key: str, ts: str, seconds: int = PERIOD) -> DataFrame:
    """df with the number of the key's rows in the seconds up to each row, itself included."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(t).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("n_recent", F.count(F.lit(1)).over(w))


def _limit(times: Iterable[float], recent: deque, period: float) -> list[bool]:
    """Only accepted requests count against the next ones: recent holds the last of them, as many as the
    limit, so the oldest decides."""
    out = []
    for t in times:
        ok = len(recent) < recent.maxlen or recent[0] < t - period
        if ok:
            recent.append(t)
        out.append(ok)
    return out


def rate_limit(df: DataFrame, key: str, ts: str, id_col: str, limit: int = LIMIT, period: float = PERIOD) -> DataFrame:
    """(id, key, accepted) over a whole log, each key's requests in order of time and identifier.

    The decision depends on earlier decisions, which no window frame can say; a key's rows come in
    order and in batches, a run of one key at a time, and the state is at most `limit` times.
    """
    kinds = dict(df.dtypes)
    rows = df.select(F.col(id_col).alias("_id"), F.col(key).alias("_key"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_t"))
    ordered = rows.repartition("_key").sortWithinPartitions("_key", "_t", "_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, recent = object(), deque(maxlen=limit)
        for f in frames:
            accepted: list[bool] = []
            for k, part in f.groupby("_key", sort=False, dropna=False):
                if k != now and not (pd.isna(k) and now is None):
                    now, recent = None if pd.isna(k) else k, deque(maxlen=limit)
                accepted += _limit(part["_t"].tolist(), recent, period)
            yield pd.DataFrame({"_id": f["_id"], "_key": f["_key"], "accepted": accepted})

    out = ordered.mapInPandas(run, f"_id {kinds[id_col]}, _key {kinds[key]}, accepted boolean")
    return out.select(F.col("_id").alias(id_col), F.col("_key").alias(key), "accepted")


def rate_limit_stream(df: DataFrame, key: str, ts: str, id_col: str, limit: int = LIMIT, period: float = PERIOD) -> DataFrame:
    """The limiter on a stream: state by key, dropped after a quiet period."""
    kinds = dict(df.dtypes)
    rows = df.select(F.col(key).alias("_key"), F.col(id_col).alias("_id"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_t"))

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0] if state.exists else [], maxlen=limit)
        f = pd.concat(list(frames)).sort_values(["_t", "_id"])
        accepted = _limit(f["_t"].tolist(), recent, period)
        state.update((list(recent),))
        state.setTimeoutDuration(int(period * 2000))
        yield pd.DataFrame({"_id": f["_id"].to_numpy(), "_key": f["_key"].to_numpy(), "accepted": accepted})

    out = rows.groupBy("_key").applyInPandasWithState(
        run, f"_id {kinds[id_col]}, _key {kinds[key]}, accepted boolean", "recent array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    return out.select(F.col("_id").alias(id_col), F.col("_key").alias(key), "accepted")


def once(df: DataFrame, ts: str, content: list[str], lateness: str) -> DataFrame:
    """A stream without repeats of the same content within the lateness."""
    return df.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(content)


def upsert_stream(df: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch through apply(batch, id), which must be idempotent in id; started once."""
    return df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
