"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import importlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions that run in Python workers travel with the plan, so an executor
# needs no copy of this package on its own path.
cloudpickle.register_pickle_by_value(importlib.import_module(__package__))

#: Bytes of one Arrow batch on its way to a Python worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for the plans made inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int):
    """Plans made inside hand at most ``rows`` rows at once to a Python worker."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder of intermediate tables that all executors see.

    ``spark.checkpoint.dir`` names it, or ``SparkContext.setCheckpointDir`` has.
    Only a session on one machine may go without: it gets a temporary folder.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parlance-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once: written as Parquet in the shared folder and read again.

    Unlike a checkpoint, a file has a known size.  A checkpoint carries the size
    the optimizer guessed, a product over joins, and in a loop those numbers get
    so long that planning never ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/parlance-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of the session exceed ``BATCH_BYTES`` of rows, however long the texts are.

    It is a setting of memory alone; results do not depend on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, f"{BATCH_BYTES}b")


def by_class(rows: DataFrame, classes: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row a ``key``; ``classes`` has ``n``, the rows of that key.

    A key of many rows would meet in one task.  Those above a quarter of an even
    share of ``total`` are at most ``4 x`` the shuffle width, so they are
    broadcast and their rows stay where they are; the others are shuffled.
    """
    heavy = F.col("n") * (4 * shuffle_width(rows.sparkSession)) > total
    hot = F.broadcast(classes.where(heavy).drop("n"))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(classes.where(~heavy).drop("n"), key))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns on the way that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def worker_cache() -> dict:
    """A dict that outlives a task in its Python worker."""
    import sys
    import types

    return sys.modules.setdefault("parlance_worker_cache", types.ModuleType("parlance_worker_cache")).__dict__
