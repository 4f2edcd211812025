"""Mixing sources to target weights, in DataFrame operations only.

Documents get hash-random keys. Within each source the keys are cut into equal ranges (the hash is
uniform, so ranges hold alike many rows); running sums within a range, over ranges, and over blocks
of ranges make the distributed prefix sum of sizes, and each source is cut at its exact budget. A
budget above the source's size takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, row_key, staying_rows, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
ROWS_PER_RANGE = 2_000
RANGES_PER_BLOCK = 1_000
SEED = 20_240_229


def source_targets(
    totals: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """totals: source, source_size, n_docs (one row per source). Adds weight and target.

    Weights go round by code point order of the source, null last. Targets share `share` of all
    sizes by weight and stop at max_epochs times the source's size; the excess goes to the others by
    weight until none is above: sources are capped in ascending order of cap per weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")
    )
    caps = totals.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * float(max_epochs))
    caps = caps.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    ranked = caps.withColumn("_level", level).withColumn("_capped", F.col("_ratio") <= F.col("_level"))
    # The first source that isn't capped fixes the level of all that follow it.
    fixed = F.min(F.when(~F.col("_capped"), F.struct(F.col("_ratio"), F.col("_level")))).over(Window.partitionBy())
    return ranked.withColumn(
        "target", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("weight") * fixed["_level"])
    ).select("source", "source_size", "n_docs", "weight", "target")


def hash_key(identifier, text, seed: int):
    """Sixty bits of the MD5 of seed, identifier and the text's MD5, as a long; nulls hash as empty. Texts of one
    identifier, null ones too, so lie in ranges of their own."""
    parts = [F.coalesce(identifier.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 10).cast("long")


def mixture(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Per row of df: doc_id, source, size, source_size, target, taken.

    Sizes are words; a null or empty text has size 0 and nothing is taken from it. A null source is
    a source of its own. Rows that share an identifier are rows of their own; the order is the hash
    of seed, identifier and text, then the identifier, then the text's hash, so reruns agree (rows that
    agree in all three are alike). An empty table gives no rows.
    """
    rows = materialize(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(text_col)).alias("_tie"),
            hash_key(F.col(id_col), F.col(text_col), seed).alias("_key"),
        ),
        "sizes",
    )
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = source_targets(totals, weights, share, max_epochs)
    # Ranges of the hash: its top 31 bits, in as many equal parts as the source's rows need.
    n_ranges = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / rows_per_range))
    ranged = (
        rows.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_unit", F.shiftright("_key", 29))
        .withColumn("_range", F.floor(F.col("_unit") * n_ranges / F.lit(2**31)))
        .withColumn("_block", F.floor(F.col("_range") / RANGES_PER_BLOCK))
    )
    sums = ranged.groupBy("source", "_block", "_range").agg(F.sum("size").alias("_sum"))
    blocks = sums.groupBy("source", "_block").agg(F.sum("_sum").alias("_sum"))
    earlier = lambda order: order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("source").alias("_bs"),
        F.col("_block").alias("_bb"),
        F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy("source").orderBy("_block"))), F.lit(0)).alias("_before_block"),
    )
    offsets = (
        sums.join(blocks, F.col("source").eqNullSafe(F.col("_bs")) & (F.col("_block") == F.col("_bb")))
        .select(
            F.col("source").alias("_os"),
            F.col("_range").alias("_or"),
            (F.col("_before_block") + F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy("source", "_block").orderBy("_range"))), F.lit(0))).alias("_before_range"),
        )
    )
    inside = earlier(Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "_tie"))
    start = F.col("_before_range") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    return (
        ranged.join(offsets, F.col("source").eqNullSafe(F.col("_os")) & (F.col("_range") == F.col("_or")))
        .withColumn("_start", start)
        .withColumn("_whole", whole)
        .withColumn("_rest", budget - F.col("_whole") * F.col("source_size"))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("_whole") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_start")))).cast("long").alias("taken"),
            "_tie",
        )
    )


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, with df's columns: whole documents once per epoch that takes them, and the
    document at a source's cut with its first words only. Documents of which nothing is taken go;
    an n_chars column is set anew for the cut text.

    Rows that agree in identifier, text and source, nulls included, share what is taken from all of
    them, and the one with the smallest hash of the whole row carries it. Null and empty texts have no
    words, so nothing of them is taken. An empty table gives no rows; df's names clash with none.
    """
    # Alike rows share what is taken from all of them; one of them carries it.
    takes = (
        mixture(df, id_col, text_col, source_col, **options)
        .groupBy(row_key("doc_id", "_tie", "source").alias("_row"))
        .agg(F.sum("taken").alias("_taken"), F.max("size").alias("_size"))
        .where("_taken > 0")
        .withColumn("_whole", F.floor(F.col("_taken") / F.col("_size")))
        .withColumn("_rest", F.col("_taken") - F.col("_whole") * F.col("_size"))
    )
    whole = F.array_repeat("_size", F.col("_whole").cast("int"))
    rest = F.when(F.col("_rest") > 0, F.array("_rest")).otherwise(F.array().cast("array<bigint>"))
    takes = takes.select("_row", "_size", F.concat(whole, rest).alias("_words"))
    row = row_key(id_col, F.xxhash64(text_col), source_col)
    pieces = staying_rows(df, row, takes, "_size", "_words").withColumn("_take", F.explode("_words"))
    own = lambda c: F.col("_df").getField(c)
    # Pieces that each begin at a word's start; the first may hold leading space.
    word_ends = F.split(own(text_col), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.when(F.col("_take") >= F.col("_size"), own(text_col)).otherwise(
        F.array_join(F.slice(word_ends, F.lit(1), F.col("_take").cast("int")), "")
    )
    changed = {text_col: cut} | ({"n_chars": F.length(cut).cast("long")} if "n_chars" in df.columns else {})
    return pieces.select(*[changed.get(c, own(c)).alias(c) for c in df.columns])
