"""Interaction audit of filters by direct replay.

Every document's flags meet every order of the filters (a broadcast table of n! rows); the step of the
first failure is computed, the steps are exploded, and each step's counts are conditional sums, which
tasks combine before anything is shuffled. What is shuffled is a row for each part, order, step and task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, materialize, salted_lookup

#: Rows of one text, or of one identifier, are dealt out over so many tasks.
SALTS = 64
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions of the filters that look at one text: few words, few distinct words, many
    capitals, marks."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 100,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(80) * n,
        "C": F.lit(100) * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(10) * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _has(mask: Column, bit: Column) -> Column:
    """Whether mask holds the bit, given as its power of two."""
    return mask.bitwiseAND(bit) != 0


def replayed(rows: DataFrame, letters: str, part: str = "part", mask: str = "mask", marks: dict[str, str] | None = None) -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails and shapley, and for each
    mark (name of a boolean column -> name of its count) those removed that bear it.

    rows: a mask for each, whose bit i says that it fails filter letters[i]. All orders are replayed for
    every row: n! times n steps, without one of them leaving its task before it is summed.
    """
    marks = marks or {}
    n = len(letters)
    orders = ["".join(p) for p in permutations(letters)]
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, *(1 << letters.index(x) for x in o)) for i, o in enumerate(orders)], "_order int, " + ", ".join(f"_b{k} int" for k in range(1, n + 1)))
    crossed = rows.select(part, F.col(mask).cast("int").alias("_mask"), *marks).join(F.broadcast(table))  # n! rows by construction
    first = F.lit(n + 1)
    for k in range(n, 0, -1):
        first = F.when(_has(F.col("_mask"), F.col(f"_b{k}")), k).otherwise(first)
    bits = F.array(*[F.col(f"_b{k}") for k in range(1, n + 1)])
    steps = crossed.withColumn("_first", first).select(part, "_order", "_mask", "_first", *marks, F.posexplode(bits).alias("_step", "_bit"))
    step, here = F.col("_step") + 1, F.col("_first") == F.col("_step") + 1
    counts = steps.groupBy(part, "_order", "_step").agg(
        F.count_if(F.col("_first") > step).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if(_has(F.col("_mask"), F.col("_bit")) & (F.col("_first") < step)).alias("redundant"),
        F.count_if(F.col("_mask") == F.col("_bit")).alias("unique_fails"),
        *[F.count_if(here & F.col(m)).alias(out) for m, out in marks.items()],
    )
    order = F.element_at(F.array(*[F.lit(o) for o in orders]), F.col("_order") + 1)
    named = counts.select(part, order.alias("filter_order"), (F.col("_step") + 1).cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", *marks.values())
    of_filter = Window.partitionBy(part, F.substring("filter_order", F.col("step"), F.lit(1)))  # as many rows as orders
    return named.withColumn("shapley", F.sum("removed").over(of_filter))


def audit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic"
) -> DataFrame:
    """The replay of five filters over df: those of text_filters, and E, a text that a row with a smaller
    identifier has too.

    A null text counts as empty, a null part as the empty one. Rows that repeat an identifier are counted
    each, and aren't smaller than one another; a null identifier is neither smaller nor larger
    than any. Of an identifier's labels one that says 1 is enough; null labels say nothing. Other columns
    aren't read. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = text_filters(text)
    mask = sum((F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(found.values())), F.lit(0))
    digest = F.struct(F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).alias("bytes"))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")  # stored, so it stays
    rows = df.select(F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask.alias("_mask"), digest.alias("_text"), salt.alias("_salt"))
    rows = materialize(rows, "flags")
    copies = rows.groupBy("_text").agg(F.min("_doc").alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    marks = labels.groupBy(F.col(id_col).cast("long").alias("_doc")).agg(
        F.coalesce(F.max(F.col(good_col) == 1), F.lit(False)).alias("_good"), F.coalesce(F.max(F.col(toxic_col) == 1), F.lit(False)).alias("_toxic")
    )
    rows = salted_lookup(rows, ["_text"], copies, "_salt", "left").drop("_text")
    rows = salted_lookup(rows, ["_doc"], marks, "_salt", "left")
    copy = F.coalesce(F.col("_doc") > F.col("_least"), F.lit(False))
    full = rows.select("part", (F.col("_mask") + F.when(copy, F.lit(1 << len(found))).otherwise(0)).alias("mask"), *[F.coalesce(m, F.lit(False)).alias(m) for m in ("_good", "_toxic")])
    return replayed(full, "".join(found) + "E", marks={"_good": "good_lost", "_toxic": "toxic_lost"})
