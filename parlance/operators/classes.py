"""Classes of words as a table: joined once per distinct word, of any size.

Function words, words of the platform and excluded words are never shown; scaffolding
carries talk without saying what it is about.  The lists are rows here, so a file of
scaffolding words may be as long as it likes, and a plan holds no list of literals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.config import DEFAULT, Settings
from parlance.functions.words import PLATFORM_WORDS, STOPWORDS

CLASSES = ("stop", "platform", "excluded", "scaffolding")


def word_classes(spark: SparkSession, settings: Settings = DEFAULT, scaffolding: DataFrame | None = None) -> DataFrame:
    """(term, stop, platform, excluded, scaffolding): one row for each word of a class.

    ``scaffolding``: (term), beside the words that ``settings`` lists.
    """
    lists = (STOPWORDS, PLATFORM_WORDS, settings.excluded_words, settings.scaffolding)
    listed = spark.createDataFrame([(w, c) for c, words in zip(CLASSES, lists, strict=True) for w in words], "term string, class string")
    if scaffolding is not None:
        listed = listed.unionByName(scaffolding.select("term", F.lit("scaffolding").alias("class")))
    return listed.groupBy("term").agg(*[F.bool_or(F.col("class") == c).alias(c) for c in CLASSES])


def classed(rows: DataFrame, classes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Words (server_id, term, ...) with ``stop``, ``scaffolding``, and ``reportable``: may it be shown?

    ``aliases``: (server_id, alias), words of the names of members, which never are.
    """
    known = classes.select("term", *[F.col(c).alias(f"_{c}") for c in CLASSES])
    hidden = aliases.select("server_id", F.col("alias").alias("term"), F.lit(True).alias("_alias")).distinct()
    joined = rows.join(known, "term", "left").join(hidden, ["server_id", "term"], "left")
    of = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(False))
    never = reduce(lambda a, b: a | b, [of(c) for c in ("stop", "platform", "excluded", "alias")])
    show = (F.length("term") >= 3) & ~never & ~F.contains("term", F.lit("'")) & ~F.startswith("term", F.lit("http"))
    return joined.select(*rows.columns, of("stop").alias("stop"), of("scaffolding").alias("scaffolding"), show.alias("reportable"))
