"""Small helpers that shape plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources.files import remove

#: Rows up to which a table of one row a community is sent to every executor.
SMALL = 2000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if it has ``rows`` rows or fewer; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes a task should have before a table is left as its files are cut.
SHARE = 16 << 20


def planned_size(df: DataFrame) -> int:
    """Bytes as the plan tells them; of a table that ``keep`` wrote, those of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is too small to be cut that far by itself.

    A Parquet file is read by as many tasks as it has row groups, so a small table
    often is one task's work.  A table of over ``SHARE`` bytes a core stays as it is.
    """
    cores, size = df.sparkSession.sparkContext.defaultParallelism, planned_size(df)
    return df.repartition(cores) if 0 < size < cores * SHARE else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of tables on the way that all executors see.

    ``spark.checkpoint.dir`` names it, or ``SparkContext.setCheckpointDir`` has.
    Only a local session may go without: it gets a temporary folder.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parlance-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Writes made inside remove their shuffle files at their end, not when the driver's garbage is collected.

    A write has a plan of its own, which nothing runs again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def keep(df: DataFrame) -> DataFrame:
    """Compute a table that many others read, once, and cut its plan off.

    It is a Parquet table of the shared folder, so its size is known to the plans
    that read it.  Without the cut, plans that read a table in several branches
    multiply.  ``forget`` removes it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/parlance-kept-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of tokens or facts whose terms are counted at once, and the most pieces that terms are cut into.
PIECE, PIECES = 32 << 20, 3


def pieces(size: int, each: Callable[[Column], DataFrame], *key: str, most: int | None = None, hold: Callable[[DataFrame], DataFrame] = keep) -> list[DataFrame]:
    """``each`` of a piece of the work after another, written where there are several, by the hash of ``key``.

    Rows of a key are in one piece, so what is counted by it is whole; the shuffle on
    the way is that of a piece.  ``hold`` writes them, as ``keep`` does.
    """
    n = min(most or PIECES, 1 + size // PIECE)
    at = F.pmod(F.xxhash64(*key), F.lit(n))
    return [hold(each(at == k)) for k in range(n)] if n > 1 else [each(F.lit(True))]


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables that ``keep`` wrote and nothing will read again."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles() if "/parlance-kept-" in f}:
            remove(spark, folder)
