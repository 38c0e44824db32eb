"""Messages from the tables of a data folder.

Documents become messages: a language is a community, a source a channel; the
author and the moment follow from doc_id.  One message in seventeen is a bot's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.plans import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id") * 7919
    ts = F.timestamp_add("MINUTE", (key % 302400).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).select(
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("id"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.col("lang").alias("server_id"),
        F.concat(F.lit("Server "), "lang").alias("server"),
        F.col("source").alias("channel"),
        F.concat(F.lit("u"), key % 41).alias("user_id"),
        F.concat(F.lit("Thing "), key % 41).alias("user"),
        (F.col("doc_id") % 17 == 0).alias("is_bot"),
        F.col("text").alias("message"),
        F.lit(None).cast("string").alias("type"),
    )


def reference(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Word and two-word frequencies (term, cnt) of the benchmark's texts."""
    from parlance.functions import text

    cleaned = table(spark, sf_dir, "benchmark").select(text.clean(F.col("text")).alias("c"))
    tokens = cleaned.select(text.word_tokens(F.col("c")).alias("t"), text.breaks(F.col("c")).alias("b"))
    rows = tokens.select(text.places(F.col("t"), F.col("b")))
    count = lambda n: rows.select(text.gram(n).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("cnt"))
    return count(1), count(2)
