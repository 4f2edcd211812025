"""What the corpus operators share: text rules, scratch tables, salted look-ups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and its complement, in the syntax of Java and of RE2.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Session settings for tables of texts: rows in an Arrow batch, which lies in the executor and in its
#: Python worker, and in a batch of the Parquet reader. Spark's own suit narrow rows.
LONG_TEXTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.parquet.columnarReaderBatchSize": "1024"}


def for_long_texts(spark: SparkSession) -> SparkSession:
    """The session with the settings of LONG_TEXTS, which queries and the pipeline's stages run under."""
    for key, value in LONG_TEXTS.items():
        spark.conf.set(key, value)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return for_long_texts(spark).read.parquet(f"{sf_dir}/documents.parquet")


def squeezed(text: Column) -> Column:
    """Text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def word_count(text: Column) -> Column:
    """Maximal runs of non-space characters, as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_own_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where it names none and
    the master is a single local process, a temporary folder; on a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="spark-lodestone-"))
    return _own_root[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/lodestone/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table at path, read back: lineage ends there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back."""
    return written(df, scratch_path(df.sparkSession, name))


class Scratch:
    """Tables of one job in a folder of its own; those that later ones replace are dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, scratch_path(spark, "job"), {}

    def write(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """df as a written table, in so many files at most; of earlier tables of this name only the
        last is kept."""
        earlier = self.paths.setdefault(name, [])
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        out = written(df.coalesce(files) if files else df, path)
        for old in earlier[:-1]:
            self._delete(old)
        self.paths[name] = [*earlier[-1:], path]
        return out

    def drop(self, *names: str) -> None:
        """Tables that no later plan reads."""
        for path in (p for n in names for p in self.paths.pop(n, [])):
            self._delete(path)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def salted_lookup(
    rows: DataFrame, keys: list[str], entries: DataFrame, salt: str, how: str = "inner"
) -> DataFrame:
    """Join rows with entries (one per key) when a key may hold a large share of the rows.

    The distinct (key, salt) pairs meet the entries first, so a hot key has as many rows there as
    there are salts; the rows then meet their own pair, spread over the salts.
    """
    pairs = rows.select(*keys, salt).distinct()
    return rows.join(pairs.join(entries, keys), [*keys, salt], how)


def row_key(*parts: str | Column) -> Column:
    """A string that tells rows apart by the parts, nulls included."""
    text = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.concat_ws("|", *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def quoted(df: DataFrame) -> list[Column]:
    """df's columns, whatever their names are."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def staying_rows(df: DataFrame, key: Column, entries: DataFrame, *extra: str) -> DataFrame:
    """df's rows whose key is in entries (_row, ...), with the extra columns of the entries.

    Of rows with one key the one with the smallest hash of the whole row stays, so reruns agree. df's
    columns travel as one struct, so their names clash with none; the texts are dealt out once, as
    the rows of a key lie together for the join and for the choice. With extra columns the result
    is that struct, _df, and them.
    """
    rows = df.select(F.struct(*quoted(df)).alias("_df"), key.alias("_row"), F.xxhash64(*quoted(df)).alias("_tie"))
    one = rows.join(entries, "_row").groupBy("_row").agg(F.min_by("_df", "_tie").alias("_df"), *[F.first(c).alias(c) for c in extra])
    return one.select("_df", *extra) if extra else one.select("_df.*")


def hash_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most `rows` rows, those with the smallest hash of the keys.

    A hash threshold leaves little more than that many before they are ordered, so what meets in one
    task is bounded by `rows` and not by the number of partitions.
    """
    share = min(1.0, 1.2 * rows / max(df.count(), 1) + 1e-6)
    order = F.xxhash64(F.lit(7), *keys)
    part = df.where(F.pmod(order, F.lit(1_000_000_000)) < int(share * 1_000_000_000)) if share < 1 else df
    return part.orderBy(order, *keys).limit(rows)
