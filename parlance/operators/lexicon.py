"""Characteristic words and repeated constructions, scored against a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.config import DEFAULT, Settings
from parlance.functions import text
from parlance.operators.classes import classed


def ln1(c: Column) -> Column:
    return F.ln(1 + c)


def log2(c: Column) -> Column:
    return F.ln(c) / F.ln(F.lit(2.0))


def ranked(df: DataFrame, *order: Column, top: int, keys: tuple[str, ...] = ("server_id",), name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= top)


def by_score() -> tuple[Column, ...]:
    return F.desc(F.round("score", 9)), F.desc("uses"), F.col("term")


def with_word_rate(df: DataFrame, words: DataFrame) -> DataFrame:
    """Add ``rate``: the word's share of the reference, or that of the word
    without apostrophes and hyphens; 0 if neither is known."""
    total = words.agg(F.greatest(F.sum("cnt"), F.lit(1)).alias("total"))
    plain = F.replace(F.replace(F.col("term"), F.lit("'")), F.lit("-"))
    exact = words.select("term", F.col("cnt").alias("_exact"))
    bare = words.select(F.col("term").alias("_bare"), F.col("cnt").alias("_cnt"))
    joined = df.join(exact, "term", "left").join(bare, plain == F.col("_bare"), "left").join(F.broadcast(total))  # one row
    rate = F.coalesce(F.nullif("_exact", F.lit(0)), F.col("_cnt"), F.lit(0)) / F.col("total")
    return joined.withColumn("rate", rate).select(*df.columns, "rate")


def vocabulary(inventory: DataFrame, totals: DataFrame, words: DataFrame, classes: DataFrame, aliases: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Window words with rate, lift, whether reportable, and whether about something.

    ``classes``: the table of ``word_classes``.
    """
    n = totals.select("server_id", F.col("tokens").alias("n"))
    rows = classed(with_word_rate(inventory.where("size = 1").join(n, "server_id"), words), classes, aliases)
    rows = rows.withColumn("lift", (F.col("uses") / F.greatest("n", F.lit(1))) / F.greatest("rate", F.lit(1e-8)))
    special = (F.col("rate") == 0) | ((F.col("rate") * 1e6 <= settings.max_reference_ppm) & (F.col("lift") >= settings.topic_min_lift))
    return rows.withColumn("about", F.col("reportable") & ~F.col("scaffolding") & special)


def lexicon(vocabulary: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Characteristic words: adoption times bounded logarithmic distinctiveness."""
    lift = F.when(F.col("rate") > 0, F.col("lift"))
    rows = vocabulary.withColumn("lift", lift).where(
        F.col("reportable") & ~F.col("scaffolding") & (F.col("uses") >= settings.min_word_uses) & (F.col("voices") >= settings.min_voices)
        & (F.col("lift").isNull() | (F.col("lift") >= settings.word_min_lift))
    )
    bounded = F.least(F.coalesce("lift", F.lit(settings.lift_ceiling)), F.lit(settings.lift_ceiling))
    score = ln1(F.col("uses")) * ln1(F.col("voices")) * log2(F.greatest(F.lit(settings.word_min_lift), bounded))
    known = lambda c: F.when(F.col("rate") > 0, c)
    return ranked(rows.withColumn("score", score), *by_score(), top=settings.top_terms).select(
        "server_id", "place", "term", "uses", "voices",
        F.when(F.col("rate") == 0, "not_found").otherwise("measured").alias("reference_status"),
        known(F.round(F.col("rate") * F.col("n"), 4)).alias("reference_expected"),
        known(F.round(F.col("rate") * 1e6, 4)).alias("reference_ppm"),
        F.round(F.col("uses") / F.greatest("n", F.lit(1)) * 1e6, 1).alias("local_ppm"),
        F.round("lift", 1).alias("lift"),
    )


def gated_phrases(inventory: DataFrame, words: DataFrame, totals: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Repeated phrases with their association (normalised PMI), kept if above 0.

    ``words`` lists (server_id, term, uses, stop, reportable, scaffolding, about).
    Gates on the phrase alone come first, so that only phrases that may pass
    meet their words.
    """
    kept = inventory.where(
        (F.col("size") > 1) & (F.col("uses") >= settings.min_phrase_uses) & (F.col("voices") >= settings.min_voices)
        & ~text.among(F.col("term"), settings.excluded_phrases)
    )
    part = words.select("server_id", F.col("term").alias("word"), F.col("uses").alias("word_uses"), "stop", "reportable", "scaffolding", "about")
    parts = kept.select("server_id", "term", F.posexplode(F.split("term", " ")).alias("at", "word")).join(part, ["server_id", "word"])
    stop = F.col("stop")
    checked = parts.groupBy("server_id", "term").agg(
        F.max(F.when(F.col("at") == 0, F.col("word_uses"))).alias("u0"), F.max(F.when(F.col("at") == 1, F.col("word_uses"))).alias("u1"),
        F.max(F.when(F.col("at") == 2, F.col("word_uses"))).alias("u2"),
        F.bool_or(~stop & ~F.col("reportable")).alias("unfit"), F.bool_and(stop | F.col("scaffolding")).alias("empty"),
        F.countDistinct(F.when(~stop & F.col("about"), F.col("word"))).alias("subjects"),
    )
    n, m = F.col("n"), F.col("m")
    sized = kept.join(checked, ["server_id", "term"]).where("not unfit and not empty").join(
        totals.select("server_id", F.col("tokens").alias("n"), F.col("messages").alias("m")), "server_id"
    )
    share = lambda c: F.col(c) / F.greatest(n, F.lit(1))
    alone = F.when(F.col("size") == 2, share("u0") * share("u1")).otherwise(share("u0") * share("u1") * share("u2"))
    p = F.col("uses") / F.greatest(n - (F.col("size") - 1) * m, F.lit(1))
    pmi = log2(p / F.greatest(alone, F.lit(1e-18)))
    return sized.withColumn("p", p).withColumn("association", pmi / F.greatest(F.lit(1e-12), -log2(p))).where("association > 0")


def phrases(gated: DataFrame, pairs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Constructions: bigrams above their reference rate, trigrams with subjects."""
    total = pairs.agg(F.greatest(F.sum("cnt"), F.lit(1)).alias("total"))
    rows = gated.join(pairs, "term", "left").join(F.broadcast(total))  # one row
    rate = F.coalesce("cnt", F.lit(0)) / F.col("total")
    rows = rows.withColumn("rate", rate).withColumn("reference_lift", F.when(F.col("size") == 2, F.col("p") / F.greatest("rate", F.lit(1e-10))))
    fit = F.when(F.col("size") == 2, (F.col("rate") == 0) | (F.col("reference_lift") >= settings.bigram_min_lift)).otherwise(
        F.col("subjects") >= settings.trigram_min_subjects
    )
    score = ln1(F.col("uses")) * ln1(F.col("voices")) * F.col("association")
    return ranked(rows.where(fit).withColumn("score", score), *by_score(), top=settings.top_terms, keys=("server_id", "size")).select(
        "server_id", "size", "place", "term", "uses", "voices", "active_days", F.round("association", 3).alias("association"), F.round("reference_lift", 1).alias("reference_lift")
    )


def qualified_bigrams(phrases: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Bigrams broad enough to be units of their own."""
    return phrases.where(
        (F.col("size") == 2) & (F.col("uses") >= settings.unit_min_uses) & (F.col("voices") >= settings.unit_min_voices) & (F.col("active_days") >= settings.unit_min_days)
    )


def contributions(facts: DataFrame, lexicon: DataFrame, phrases: DataFrame) -> DataFrame:
    """(server_id, speaker, size, term, uses) for the published terms only."""
    shown = lexicon.select("server_id", F.lit(1).alias("size"), "term").unionByName(phrases.select("server_id", "size", "term"))
    return roll_up_people(facts).join(shown, ["server_id", "size", "term"], "left_semi")


def roll_up_people(facts: DataFrame) -> DataFrame:
    return facts.where("is_current").groupBy("server_id", "speaker", "size", "term").agg(F.sum("uses").alias("uses"))


def without_voices(rows: DataFrame, contributions: DataFrame, excluded: DataFrame) -> DataFrame:
    """``uses`` and ``voices`` of published terms without the excluded speakers."""
    gone = contributions.join(excluded, ["server_id", "speaker"], "left_semi").groupBy("server_id", "size", "term").agg(
        F.sum("uses").alias("gone"), F.count("*").alias("gone_voices")
    )
    left = lambda c, g: F.greatest(F.lit(0), F.col(c) - F.coalesce(g, F.lit(0)))
    return rows.join(gone, ["server_id", "size", "term"], "left").withColumns({"uses": left("uses", "gone"), "voices": left("voices", "gone_voices")}).drop("gone", "gone_voices")


def lexicon_lens(lexicon: DataFrame, contributions: DataFrame, people: DataFrame, totals: DataFrame, excluded: DataFrame, settings: Settings = DEFAULT, top: int = 18) -> DataFrame:
    """The lexicon again, as if the excluded speakers had been silent."""
    silent = people.join(excluded, ["server_id", "speaker"], "left_semi").groupBy("server_id").agg(F.sum("tokens").alias("silent"))
    share = totals.select("server_id", "tokens").join(silent, "server_id", "left").select(
        "server_id", (F.greatest(F.lit(1), F.col("tokens") - F.coalesce("silent", F.lit(0))) / F.col("tokens")).alias("share")
    )
    rows = without_voices(lexicon.withColumn("size", F.lit(1)), contributions, excluded).join(share, "server_id")
    rows = rows.withColumn("expected", F.col("reference_expected") * F.col("share")).withColumn("lift", F.col("uses") / F.greatest("expected", F.lit(1e-12)))
    rows = rows.withColumn("lift", F.when(F.col("expected").isNotNull(), F.col("lift"))).where(
        (F.col("uses") >= settings.min_word_uses) & (F.col("voices") >= 2) & (F.col("lift").isNull() | (F.col("lift") >= settings.word_min_lift))
    )
    bounded = F.least(F.coalesce("lift", F.lit(settings.lift_ceiling)), F.lit(settings.lift_ceiling))
    score = ln1(F.col("uses")) * ln1(F.col("voices")) * log2(F.greatest(F.lit(settings.word_min_lift), bounded))
    return ranked(rows.drop("place").withColumn("score", score), *by_score(), top=top).select("server_id", "place", "term", "uses", "voices", F.round("expected", 4).alias("expected"))


def phrase_lens(phrases: DataFrame, contributions: DataFrame, excluded: DataFrame, settings: Settings = DEFAULT, top: int = 16) -> DataFrame:
    rows = without_voices(phrases.drop("place"), contributions, excluded).where((F.col("uses") >= settings.min_phrase_uses) & (F.col("voices") >= 2))
    score = ln1(F.col("uses")) * ln1(F.col("voices")) * F.col("association")
    return ranked(rows.withColumn("score", score), *by_score(), top=top).select("server_id", "place", "size", "term", "uses", "voices")
