"""From raw documents to packed training sequences: five stages over whole tables.

Each stage takes (spark, docs, sf_dir), reads all that its predecessor kept and returns the columns
of documents; the last returns the pieces of packed sequences. A table of the shared folder lies
between two stages.

Null texts count as empty and are rejected by the first stage. Null identifiers come first where the smallest stays;
rows that repeat one are told apart by their texts, and of rows alike throughout one stays in exact_duplicates.
Columns of any name travel along. Empty tables, of documents or after a stage, give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import documents, for_long_texts, materialize
from lodestone.llm.exact_dedup import drop_duplicates
from lodestone.llm.mixing import mixed_documents
from lodestone.llm.packing import pack_documents
from lodestone.llm.quality import quality_filter
from lodestone.llm.shingle_join import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    for_long_texts(spark)
    return quality_filter(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    for_long_texts(spark)
    return drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts the one with the smallest doc_id stays."""
    for_long_texts(spark)
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target sizes: rows are left out, repeated, or cut at a source's budget."""
    for_long_texts(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2,048 tokens, with their ids."""
    for_long_texts(spark)
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Tokenizing, shingle sets and window packing aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
