"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition makes a run: its distinct digests with the smallest identifier and a count.
In each round FAN_IN neighbouring runs meet in an exchange on (run, digest), and each stretch of
digests is merged by a sort aggregate, which keeps the smallest identifier; after
log_FAN_IN(partitions) rounds one run is left. Each level is stored as it comes out of its merge, its runs
sorted by digest in every file, so that the next exchange reads ascending stretches and a lost executor
costs one level at most. Digests are SHA-256; each level also holds rows together by length and by an
independent 64-bit hash, so that an identifier is only retained for rows whose three fingerprints agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, row_key, squeezed, staying_rows

FAN_IN = 8
_KEY = ["_digest", "_length", "_check"]


def digest_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row per input row: identifier, fingerprints, run, position."""
    return df.select(F.col(id_col).alias("_id"), squeezed(F.col(text_col)).alias("_text")).select(
        "_id",
        F.unhex(F.sha2("_text", 256)).alias("_digest"),
        F.length("_text").alias("_length"),
        F.xxhash64("_text").alias("_check"),
        F.spark_partition_id().alias("_run"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def stored_runs(runs: DataFrame, name: str) -> DataFrame:
    """A level of runs as a written table, sorted by run and digest in every file. Where a level has few
    rows for its files, AQE has joined its partitions, each of whole stretches."""
    return materialize(runs.sortWithinPartitions("_run", *_KEY), name)


def merge_runs(runs: DataFrame, fan_in: int) -> DataFrame:
    """One round: fan_in neighbouring runs become one."""
    return (
        runs.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int"))
        .groupBy("_run", *_KEY)
        .agg(F.min("_head").alias("_head"), F.sum("_n").alias("_n"))
    )


def duplicate_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN
) -> DataFrame:
    """Per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space is one space; null
    counts as empty. The smallest identifier stays; null identifiers come last, and of rows that
    share the smallest identifier exactly one has kept = true. An empty table gives no rows.
    """
    rows = materialize(digest_rows(df, id_col, text_col), "digests")
    leaf = rows.groupBy("_run", *_KEY).agg(
        F.min(F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_seq").alias("seq"))).alias("_head"),
        F.count(F.lit(1)).alias("_n"),
    )
    leaf = stored_runs(leaf, "runs")
    n_runs = (leaf.agg(F.max("_run")).first()[0] or 0) + 1
    top = leaf
    while n_runs > 1:
        top, n_runs = stored_runs(merge_runs(top, fan_in), "runs"), -(-n_runs // fan_in)
    # Down again: a hot digest has one row per run in the leaves, and its rows are spread over runs.
    placed = leaf.select("_run", *_KEY).join(top.drop("_run"), _KEY)
    return rows.join(placed, ["_run", *_KEY]).select(
        F.col("_id").alias("doc_id"),
        F.col("_head.id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_seq") == F.col("_head.seq")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN
) -> DataFrame:
    """The rows of df that stay, with all its columns: of equal texts the one with the smallest identifier,
    null ones last; of rows that share it the one with the smallest hash of the whole row. df's names
    clash with none. An empty table gives no rows."""
    groups = duplicate_groups(df, id_col, text_col, fan_in).where("kept")
    kept = groups.select(row_key("doc_id", "text_sha256").alias("_row")).distinct()
    return staying_rows(df, row_key(id_col, F.sha2(squeezed(F.col(text_col)), 256)), kept)
