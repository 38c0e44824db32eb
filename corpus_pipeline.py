"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, as a table of documents; all but the
last return the columns of documents.  ``n_chars`` follows the text.  Extra
columns are dropped.  A document is a row: rows that share a doc_id and differ in
text are documents of their own, and so are rows with a null doc_id, which come
after all others where an order counts.  The first stage writes what it told into
``lang``; the next three hand it on, and the last packs each language apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import language_id, line_dedup, near_copies, packing, suffix_dedup
from parlance.llm.common import durable, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A source is a collection, not a host, so a line on few of its documents counts as common.
LINE_PERCENT, LINE_LEAST = 0.2, 5
#: SQL cannot express the classifier or the fingerprints; tests use brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the language told from the text; documents in none (no text, or no letter) go.

    ``und`` can also mean that no labelled row could be learned from; such texts stay.
    """
    told = language_id.identify(docs).where((F.col("lang_pred") != "und") | F.col("text").rlike(r"\p{L}"))
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on over 0.2% of a source's documents, or of all, and five at least, go; the documents stay."""
    kept = line_dedup.drop_boilerplate(docs.select(*COLUMNS), F.col("source"), F.split("text", "\n"), LINE_PERCENT, LINE_LEAST, overall=True)
    return with_text(kept, F.array_join("kept_lines", "\n"))


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at five-word similarity 0.8 the smallest doc_id stays, once.

    The SimHash index proposes links; so do further fingerprints; all are confirmed exactly.
    """
    return near_copies.survivors(docs.select(*COLUMNS)).select(*COLUMNS)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 50 bytes go; a character that loses a byte goes whole.

    Rows with a null doc_id have no place in the order and stay as they are.
    """
    found = suffix_dedup.repeated_spans(docs.where("doc_id is not null"), ("lang", "source"), as_text=True)
    kept = with_text(found.select("doc_id", F.col("kept").alias("text"), "carry.lang", "carry.source"), F.col("text"))
    return kept.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of at most 2048, each of one language."""
    pieces = packing.token_pieces(docs, carry=("lang",)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = packing.place_apart(pieces, docs, "lang")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "lang")


def with_text(df: DataFrame, text) -> DataFrame:
    done = df.withColumn("text", text)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_near_copies),
    ("suffix-array dedup", dedup_substrings),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
