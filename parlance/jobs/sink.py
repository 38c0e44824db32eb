"""Published reports: a manifest says which tables a version has and where they are.

A version is a folder of tables and one manifest file.  The manifest comes last, in
one file, so a version is published whole or not at all.  It keeps schema and row
count of each table; a table without rows is read with its schema like any other.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.sources import files

MANIFEST = "version STRING, name STRING, schema STRING, n_rows BIGINT, folder STRING"


def write_table(df: DataFrame, path: str, version: str, name: str) -> tuple[str, str, str, int, str]:
    """Write a table of a version, by server where it has one; its row of the manifest.

    Rows are counted as they stand in the files.
    """
    folder = f"versions/{version}/{name}"
    write = df.write.partitionBy("server_id") if "server_id" in df.columns else df.write
    write.parquet(f"{path}/{folder}")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{folder}").count()
    return version, name, df.schema.json(), written, folder


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, versions: int = 3, orphan_hours: float = 24) -> str:
    """Write all tables under a new version, publish it, and retire old ones; returns the version.

    A failure on the way leaves the version published last in force.
    """
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    rows = [write_table(df, path, version, name) for name, df in tables.items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{path}/manifests/{version}")
    retire(spark, path, versions, orphan_hours)
    return version


def published(spark: SparkSession, path: str) -> list[str]:
    """Versions with a manifest, the latest last."""
    return [v for v in files.children(spark, f"{path}/manifests") if files.written(spark, f"{path}/manifests/{v}")]


def retire(spark: SparkSession, path: str, versions: int = 3, orphan_hours: float = 24) -> None:
    """Keep the last ``versions`` published; remove older ones, and with them servers that are gone.

    A folder without a manifest may belong to a writer at work: it goes only when it
    is ``orphan_hours`` old.
    """
    known = published(spark, path)
    for version in known[: -max(1, versions)]:
        files.remove(spark, f"{path}/manifests/{version}")  # first, so that no manifest names what is gone
        files.remove(spark, f"{path}/versions/{version}")
    for version in files.children(spark, f"{path}/versions"):
        begun = int(version.partition("-")[0]) if version.partition("-")[0].isdigit() else None
        if version not in known and begun is not None and time.time_ns() - begun > orphan_hours * 3600e9:
            files.remove(spark, f"{path}/versions/{version}")


def manifest(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The manifest of a version, the one published last by default."""
    known = published(spark, path)
    if not known or version not in (None, *known):
        raise FileNotFoundError(f"no report is published at {path}" if version is None else f"{version} is not published at {path}")
    return spark.read.schema(MANIFEST).json(f"{path}/manifests/{version or known[-1]}")


def read_table(spark: SparkSession, path: str, name: str, version: str | None = None) -> DataFrame:
    """A table of a published report."""
    row = manifest(spark, path, version).where(F.col("name") == name).first()
    if row is None:
        raise KeyError(f"the report at {path} has no table {name}")
    schema = T.StructType.fromJson(json.loads(row["schema"]))
    return spark.read.schema(schema).parquet(f"{path}/{row['folder']}").select(*schema.names)
