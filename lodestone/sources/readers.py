"""Sources: delimited files with declared schemas, registries, paged services, landed objects."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Raw activity rows are strings on disk; casts are explicit and never throw.
RAW_ACTIVITY = (
    "activity_id string, molecule_id string, molecule_name string, structure string, standard_value string, standard_units string, "
    "standard_relation string, pchembl_value string, assay_type string, assay_id string, validity_comment string, document_id string, document_year string"
)


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    """A headed file with a declared schema; empty strings are null."""
    return spark.read.csv(path, schema=schema, header=True, sep=separator, quote='"', escape='"', nullValue="", mode="PERMISSIVE")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_csv(spark, path, schema, "\t")


def read_screening_csv(spark: SparkSession, path: str, columns: list[str], tag: str, number: str) -> DataFrame:
    """A screening export whose first rows describe the columns: those have no numeric tag. The number
    column becomes double, null where it isn't one."""
    raw = read_csv(spark, path, ", ".join(f"`{c}` string" for c in columns))
    return raw.where(F.expr(f"try_cast(`{tag}` as bigint)").isNotNull()).withColumn(number, F.expr(f"try_cast(`{number}` as double)"))


def activity_fault(flags: tuple[str, ...]) -> Column:
    """Why a raw activity can't be used, the first reason that holds, or null: no identifier, no structure, no value, a
    relation other than "=", a validity comment that is one of the flags. A missing comment is fine."""
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(none("molecule_id"), "no_molecule").when(none("structure"), "no_structure").when(none("standard_value"), "no_value")
        .when(~F.col("standard_relation").eqNullSafe("="), "censored").when(F.coalesce("validity_comment", F.lit("")).isin(*flags), "flagged")
    )


def usable_activities(raw: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    """Rows that nothing is held against."""
    return raw.where(activity_fault(flags).isNull())


def activity_drops(raw: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    """(fault, n) of the rows that usable_activities leaves out."""
    return raw.select(activity_fault(flags).alias("fault")).where("fault is not null").groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def external_label(outcome: Column, potency: Column, threshold: float) -> Column:
    """Null (dropped) if inconclusive or unknown; inactive without potency is 0; else by threshold."""
    return (
        F.when(outcome == "Inconclusive", None).when((outcome == "Inactive") & potency.isNull(), 0)
        .when(potency.isNotNull(), (potency * 1000 <= threshold).cast("int"))
    )


def external_rows(df: DataFrame, outcome: str, potency: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows with their label, and (outcome, n) of those that have none."""
    labelled = df.withColumn("label", external_label(F.col(outcome), F.col(potency), threshold))
    return labelled.where("label is not null"), labelled.where("label is null").groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


def read_yaml(spark: SparkSession, path: str):
    """A YAML document of any file system that Spark reads; a registry written by hand fits the driver."""
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """A YAML registry of sources as rows: source_id and its licence."""
    doc = read_yaml(spark, path)
    if not isinstance(doc, dict) or "sources" not in doc:
        raise ValueError("a registry is a mapping with the key sources")
    rows = []
    for s in doc["sources"]:
        lic = s.get("license") or {}
        rows.append((s.get("source_id"), s.get("name"), s.get("homepage"), s.get("role"), lic.get("spdx"), lic.get("tier"), _flag(lic.get("commercial_ok")), _flag(lic.get("sharealike")), lic.get("attribution"), len(lic.get("split_licensing") or [])))
    return spark.createDataFrame(
        rows, "source_id string, name string, homepage string, role string, spdx string, tier string, commercial_ok boolean, sharealike boolean, attribution string, portions int"
    )


def _flag(value) -> bool | None:
    return None if value is None else value is True or str(value).lower() in ("true", "yes", "partial")


def read_model_registry(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each well-formed model card in a folder."""
    cards = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED")
    return cards.json(f"{folder}/*.json", schema="model_id string, version string, endpoint string, status string, feature_set_id string, dataset_version string")


def landed_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of each file under a path; files of any size, read chunk by chunk."""
    from lodestone.sources.landing import file_digests

    return file_digests(spark, path)


def digest_mismatches(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files whose content isn't what was recorded, and recorded ones that are missing.

    expected: path, sha256.
    """
    found = landed_digests(spark, path).select("path", F.col("sha256").alias("_found"))
    joined = expected.join(found, "path", "left")
    return joined.where(~F.lower("sha256").eqNullSafe(F.lower("_found"))).select("path", "sha256", F.col("_found").alias("found"))


class DigestMismatch(ValueError):
    """A file isn't what was recorded, or isn't there."""


class Refused(ValueError):
    """A server's answer that another try won't change."""


def verified(spark: SparkSession, folder: str, expected: dict[str, str]) -> str:
    """The folder, if each named file in it has its recorded SHA-256; else an error. To be asked before an
    artifact is loaded."""
    rows = spark.createDataFrame([(name, sha) for name, sha in expected.items()], "name string, sha256 string")
    found = landed_digests(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("_found"))
    bad = rows.join(found, "name", "left").where(~F.lower("sha256").eqNullSafe(F.lower("_found"))).orderBy("name").collect()  # of the named files
    if bad:
        raise DigestMismatch("; ".join(f"{r['name']}: {'missing' if r['_found'] is None else 'other content'}" for r in bad))
    return folder


def download(url: str, path: str, sha256: str, open_url: Callable | None = None, tries: int = 4, rounds: int = 3, pause: float = 0.5, chunk: int = 1 << 20) -> int:
    """One file of a service to a local landing path, where the driver is; returns its bytes.

    Streamed under another name and renamed when its digest is right. Answers 429 and 5xx and broken
    connections are tried again with growing pauses, other refusals aren't; a wrong digest starts the
    file anew, `rounds` times at most.
    """
    import hashlib
    import os
    import urllib.error
    import urllib.request

    open_url = open_url or urllib.request.urlopen
    for turn in range(rounds):
        digest, size = hashlib.sha256(), 0
        for attempt in range(tries):
            digest, size = hashlib.sha256(), 0
            try:
                with open_url(url) as source, open(f"{path}.part", "wb") as out:
                    while data := source.read(chunk):
                        digest.update(data)
                        size += len(data)
                        out.write(data)
                break
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500:
                    raise Refused(f"{url}: {e.code}") from e
                last = e
            except (ConnectionError, urllib.error.URLError) as e:
                last = e
            if attempt + 1 == tries:
                raise ConnectionError(f"{url}: no answer after {tries} tries") from last
            time.sleep(pause * 2**attempt)
        if digest.hexdigest() == sha256.lower():
            os.replace(f"{path}.part", path)
            return size
    os.remove(f"{path}.part")
    raise DigestMismatch(f"{url}: not the recorded content after {rounds} downloads")


def read_split(spark: SparkSession, path: str, group: str, groups: list[int], columns: list[str]) -> DataFrame:
    """The columns of a split's groups; with the table partitioned by group only its folders are read."""
    return spark.read.parquet(path).where(F.col(group).isin(*groups)).select(*columns)


def load_license_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A YAML registry's licence blocks of every kind, one row each, as license_audit() takes them."""
    doc = read_yaml(spark, path)
    rows = []

    def add(source, context, kind, lic, *, entry=None):
        entry, there = entry or {}, isinstance(lic, dict)
        lic = lic if there else {}
        rows.append((
            source, context, kind, there, lic.get("spdx"), lic.get("tier"), _flag(lic.get("commercial_ok")), _flag(lic.get("sharealike")), lic.get("attribution"),
            len(lic.get("split_licensing") or []), len(lic.get("exclusions") or []), bool((entry.get("cadence") or {}).get("stale")),
            (entry.get("verification") or {}).get("status") == "unverified", entry.get("reason"),
        ))

    for entry in doc.get("sources") or []:
        name, lic = entry.get("source_id", "<unnamed>"), entry.get("license")
        add(name, "", "source", lic, entry=entry)
        for part in (lic or {}).get("split_licensing") or []:
            add(name, part.get("portion", "?"), "portion", part)
        if (lic or {}).get("default_spdx") is not None:
            add(name, "default", "default", {"spdx": lic["default_spdx"], "tier": lic.get("default_tier"), "attribution": lic.get("attribution")})
        for part in (lic or {}).get("exclusions") or []:
            add(name, part.get("dataset", "?"), "exclusion", part)
    for entry in doc.get("excluded_sources") or []:
        add(entry.get("source_id", "<unnamed>"), "", "excluded", entry.get("license") or {}, entry=entry)
    return spark.createDataFrame(
        rows, "source_id string, context string, kind string, licensed boolean, spdx string, tier string, commercial_ok boolean, sharealike boolean, "
        "attribution string, portions int, exclusions int, stale boolean, unverified boolean, reason string"
    )


class _Page(InputPartition):
    def __init__(self, offset: int):
        super().__init__(offset)
        self.offset = offset


class PagedReader(DataSourceReader):
    """One partition for each page; transient failures are tried again with growing pauses."""

    def __init__(self, fetch: Callable[[int, int], list[tuple]], total: int, size: int, tries: int = 4, pause: float = 0.5):
        self.fetch, self.total, self.size, self.tries, self.pause = fetch, total, size, tries, pause

    def partitions(self):
        return [_Page(o) for o in range(0, self.total, self.size)] or [_Page(0)]

    def read(self, partition) -> Iterator[tuple]:
        for attempt in range(self.tries):
            try:
                yield from self.fetch(partition.offset, self.size)
                return
            except ConnectionError:
                if attempt + 1 == self.tries:
                    raise
                time.sleep(self.pause * 2**attempt)


def paged_source(source_name: str, columns: str, fetch: Callable[[int, int], list[tuple]], total: int, size: int = 1000, pause: float = 0.5) -> type[DataSource]:
    """A data source over a service that answers fetch(offset, limit); register it with spark.dataSource."""

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return source_name

        def schema(self):
            return columns

        def reader(self, schema):
            return PagedReader(fetch, total, size, pause=pause)

    return Paged
