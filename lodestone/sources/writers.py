"""Sinks: write-once tables, sorted exports with a manifest, append-only logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from lodestone.operators.governance import insert_absent
from lodestone.session import stored
from lodestone.sources.readers import landed_digests


def write_once(df: DataFrame, path: str) -> None:
    """Refuses to write over what is there."""
    df.write.mode("errorifexists").parquet(path)


def write_partitioned(df: DataFrame, path: str, *columns: str) -> None:
    """Partition folders prune scans that filter on these columns."""
    df.write.partitionBy(*columns).parquet(path)


def write_sorted_csv(df: DataFrame, path: str, *keys: str) -> int:
    """A total sort by keys, a part file for each range; concatenated in order they are one sorted file.
    Returns the rows. They are counted after the sort, whose ranges are found by a pass of their own."""
    seen = Observation()
    df.orderBy(*keys).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").csv(path, header=True, quoteAll=False, escape='"')
    return seen.get["n"]


def content_digest(df: DataFrame) -> DataFrame:
    """Rows and an order-free digest: the sum of the rows' 64-bit hashes as a decimal."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("digest"))


def back_up(spark: SparkSession, source: str, target: str) -> bool:
    """Copies a table and says whether rows and digest agree."""
    df = spark.read.parquet(source)
    write_once(df, target)
    return content_digest(df).first() == content_digest(spark.read.parquet(target)).first()


class RestoreRefused(ValueError):
    """A copy that isn't what was recorded, or a target that is there already."""


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder, where it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path(source)):
        return False
    if not store.rename(path(source), path(target)):
        raise OSError(f"{source} can't be moved to {target}")
    return True


def restore(spark: SparkSession, copy: str, recorded: tuple[int, str], target: str, force: bool = False) -> int:
    """Puts a copy back, if its rows and digest are the recorded ones (as content_digest gives them), and says how
    many rows there are. A target that is there is an error; with force it is kept as `<target>.pre-restore`.
    """
    df = spark.read.parquet(copy)
    if tuple(content_digest(df).first()) != tuple(recorded):
        raise RestoreRefused(f"{copy} isn't what was recorded")
    fresh = f"{target}.{uuid.uuid4().hex}"
    write_once(df, fresh)
    if tuple(content_digest(spark.read.parquet(fresh)).first()) != tuple(recorded):
        raise RestoreRefused("what was written differs from the copy")
    _swapped(spark, fresh, target, f"{target}.pre-restore", force)
    return recorded[0]


def _swapped(spark: SparkSession, fresh: str, target: str, earlier: str, force: bool) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path(target)):
        if not force:
            store.delete(path(fresh), True)
            raise RestoreRefused(f"{target} is there already")
        store.delete(path(earlier), True)
        _moved(spark, target, earlier)
    _moved(spark, fresh, target)


def replace(df: DataFrame, path: str) -> DataFrame:
    """Writes df beside the table at path and puts it in the table's place, so df may be made from that table; the
    table before stays as `<path>.before`. Returns the table as it is then."""
    spark, fresh = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    write_once(df, fresh)
    _swapped(spark, fresh, path, f"{path}.before", True)
    return spark.read.parquet(path)


def append_absent(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys the table lacks; repeated runs add nothing. Returns how many were added."""
    spark = df.sparkSession
    try:
        existing = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        existing = df.limit(0)
    seen = Observation()
    insert_absent(existing, df, keys).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def record_snapshot(snapshots: DataFrame, path: str) -> int:
    """Appends snapshots (source_id, version, sha256, ...); one that is there already isn't recorded again."""
    return append_absent(snapshots, path, ["source_id", "version", "sha256"])


def append_log(df: DataFrame, path: str) -> None:
    """Predictions and rejections alike; columns may be added over time."""
    df.write.mode("append").option("mergeSchema", True).parquet(path)


def rejections(df: DataFrame, reason: Column, key: str) -> DataFrame:
    """A record for the log of each row that has a reason against it."""
    return df.where(reason.isNotNull()).select(F.col(key), F.lit("rejected").alias("outcome"), reason.alias("reason"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def fan_out(df: DataFrame, base: str, targets: dict[str, list[str]], required: dict[str, str], tier: str) -> dict[str, int]:
    """One processed table into several: target -> columns; rows with a null required column only go
    to the targets that don't require it. Partitioned by licence tier; returns the rows written. The input is evaluated
    once, into a table that the targets are read from."""
    counts, df = {}, stored(df, "fan-out")
    for name, columns in targets.items():
        part = df.where(F.col(required[name]).isNotNull()) if name in required else df
        seen = Observation()
        write_partitioned(part.select(*dict.fromkeys([*columns, tier])).observe(seen, F.count(F.lit(1)).alias("n")), f"{base}/{name}", tier)
        counts[name] = seen.get["n"]
    return counts


def export_with_manifest(df: DataFrame, path: str, *keys: str) -> DataFrame:
    """A sorted export under path/data, and path/manifest with a JSON row for it: rows, columns and a digest of
    the part files' digests in order, which is the digest of the bytes as they lie. Returns the manifest."""
    spark = df.sparkSession
    rows = write_sorted_csv(df, f"{path}/data", *keys)
    parts = landed_digests(spark, f"{path}/data").where(F.col("path").endswith(".csv")).select(F.element_at(F.split("path", "/"), -1).alias("part"), "length", "sha256")
    # A row for each part file, of which there are as many as tasks wrote.
    listed = F.array_sort(F.collect_list(F.struct("part", "length", "sha256")))
    manifest = parts.agg(listed.alias("parts")).select(
        F.lit(rows).cast("long").alias("rows"), F.lit(",".join(df.columns)).alias("columns"), F.lit(",".join(keys)).alias("sorted_by"),
        F.sha2(F.array_join(F.transform("parts", lambda p: p["sha256"]), ""), 256).alias("sha256"), "parts",
    )
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")


def csv_field(value: Column) -> Column:
    """A field of a CSV line: quoted where it holds a comma, a quote or a line break; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike("[,\"\\r\\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(df: DataFrame, separator: str = "|") -> Column:
    """A row as a CSV line; arrays are joined by the separator."""
    fields = [F.array_join(F.col(f.name).cast("array<string>"), separator) if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in df.schema.fields]
    return F.concat_ws(",", *[csv_field(f) for f in fields])


def rounded(value: Column, kind: DataType, digits: int = 6) -> Column:
    """A value with every double in it rounded and every struct's fields in order of their names."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.round(value, digits)
    if isinstance(kind, StructType):
        fields = [rounded(value.getField(f.name), f.dataType, digits).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: rounded(x, kind.elementType, digits))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, v: rounded(v, kind.valueType, digits))
    return value


def export_json(df: DataFrame, digits: int = 6) -> DataFrame:
    """One JSON string for each row, keys in order and doubles rounded at every depth: stable fixtures and
    exports."""
    fields = [rounded(F.col(f.name), f.dataType, digits).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return df.select(F.to_json(F.struct(*fields)).alias("json"))
