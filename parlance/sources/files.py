"""Folders of any store that Spark reads: list, move, remove."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it is not there."""
    fs, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files in a folder; 0 if it is not there."""
    fs, at = _at(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def make(spark: SparkSession, path: str) -> None:
    """A folder, with its parents."""
    fs, at = _at(spark, path)
    fs.mkdirs(at)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder; its new parent is made, and ``to`` must not be there."""
    fs, at = _at(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(at, target):
        raise OSError(f"{path} could not be moved to {to}")


def written(spark: SparkSession, path: str) -> bool:
    """Did a write of one file to this folder come to its end?"""
    return any(name.startswith("part-") for name in children(spark, path))
