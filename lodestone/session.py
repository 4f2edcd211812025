"""Session construction and table access shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    app: str = "lodestone",
    master: str | None = None,
    overrides: dict[str, str] | None = None,
) -> SparkSession:
    """Precedence: overrides, then LODESTONE_CONF_* of the environment, then DEFAULTS."""
    settings = dict(DEFAULTS)
    for key, value in os.environ.items():
        if key.startswith("LODESTONE_CONF_"):
            settings[key.removeprefix("LODESTONE_CONF_").replace("__", ".")] = value
    settings |= overrides or {}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folder: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; where it names none and
    the master is a single local process, a temporary one. On a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-lodestone-"))
    return _own_folder[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/lodestone/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a written table of the shared folder, read back: it is evaluated once, and lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
