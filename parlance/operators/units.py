"""Semantic units: messages read again with qualified bigrams as one unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.config import DEFAULT, Settings
from parlance.functions import text
from parlance.functions.plans import small
from parlance.functions.words import PLATFORM_WORDS, STOPWORDS


def listed(terms: DataFrame, name: str) -> DataFrame:
    """(server_id, name): the few terms of each community as one array."""
    return small(terms.groupBy("server_id").agg(F.collect_set("term").alias(name)))


def unit_rows(tokens: DataFrame, bigrams: DataFrame) -> DataFrame:
    """Current messages with ``units``: (term, kind, start, end, content) by place.

    A qualified bigram claims its two tokens, left to right.  Candidate places
    are written as a string of 0 and 1, in which the pattern ``1.`` finds exactly
    these claims, since matches go left to right and do not overlap.  A message
    never leaves its row; the bigrams, at most ``top_terms`` a community, come to it.
    """
    current = tokens.where("is_current").join(listed(bigrams, "_pairs"), "server_id", "left")
    t, b = F.col("tokens"), F.col("breaks")
    fits = lambda w, i: ~F.get(b, i) & F.array_contains("_pairs", F.concat_ws(" ", w, F.get(t, i + 1)))
    places = F.when(F.col("_pairs").isNull(), F.transform(t, lambda w: F.lit("0"))).otherwise(F.transform(t, lambda w, i: F.when(fits(w, i), "1").otherwise("0")))
    roles = F.split(F.regexp_replace(F.array_join(places, ""), "1.", "HT"), "")
    told = current.withColumn("_roles", roles)
    role = lambda i: F.get(F.col("_roles"), i)

    def unit(word: Column, i: Column) -> Column:
        head = role(i) == "H"
        return F.struct(
            F.when(head, F.concat_ws(" ", word, F.get(t, i + 1))).otherwise(word).alias("term"),
            F.when(head, "bigram").otherwise("word").alias("kind"),
            i.alias("start"), F.when(head, i + 1).otherwise(i).alias("end"),
            (head | ~text.among(word, STOPWORDS + PLATFORM_WORDS)).alias("content"),
            (role(i) == "T").alias("tail"),
        )

    units = F.filter(F.transform(t, unit), lambda u: ~u["tail"])
    return told.select("id", "server_id", "speaker", "channel", "day", units.alias("units"))


def unit_facts(units: DataFrame) -> DataFrame:
    """Uses and content documents of each unit by speaker, channel and day.

    A message adds one use a unit and one document a distinct content unit, so
    one shuffle, after partial sums, is all.  Units are made distinct by their term,
    as a bigram has a space and a word has none: Spark hashes strings there, but
    compares structs pair by pair, the square of a long message.
    """
    entry = lambda term, use, doc: F.struct(term.alias("term"), F.lit(use).alias("use"), F.lit(doc).alias("doc"))
    content = F.array_distinct(F.transform(F.filter("units", lambda u: u["content"]), lambda u: u["term"]))
    every = F.concat(F.transform("units", lambda u: entry(u["term"], 1, 0)), F.transform(content, lambda term: entry(term, 0, 1)))
    one = units.select("server_id", "speaker", "channel", "day", F.inline(every))
    one = one.withColumn("kind", F.when(F.contains("term", F.lit(" ")), "bigram").otherwise("word"))
    return one.groupBy("server_id", "term", "kind", "speaker", "channel", "day").agg(F.sum("use").alias("uses"), F.sum("doc").alias("documents"))


def folded(terms: DataFrame, observed: DataFrame) -> DataFrame:
    """(server_id, term) -> adds ``canonical``: the first observed singular, else the term."""
    tries = terms.select("server_id", "term").distinct().select(
        "server_id", "term", F.posexplode(F.array(*text.fold_candidates(F.col("term")))).alias("at", "canonical")
    )
    seen = observed.select("server_id", F.col("term").alias("canonical"))
    best = tries.where("canonical is not null").join(seen, ["server_id", "canonical"], "left_semi").groupBy("server_id", "term").agg(F.min_by("canonical", "at").alias("canonical"))
    return terms.join(best, ["server_id", "term"], "left").withColumn("canonical", F.coalesce("canonical", "term"))


def canonical_facts(facts: DataFrame, observed: DataFrame) -> DataFrame:
    """Unit facts with words under their singular; bigrams stay literal."""
    words = folded(facts.where("kind = 'word'"), observed)
    return words.withColumn("term", F.col("canonical")).drop("canonical").unionByName(facts.where("kind = 'bigram'"))


def unit_inventory(canonical: DataFrame, totals: DataFrame) -> DataFrame:
    """Uses, voices and documents of each canonical unit; voices are counted anew."""
    rows = canonical.groupBy("server_id", "term", "kind").agg(
        F.sum("uses").alias("uses"), F.countDistinct("speaker").alias("voices"), F.sum("documents").alias("documents")
    )
    m = totals.select("server_id", F.col("messages").alias("m"))
    return rows.join(m, "server_id").withColumn("documents", F.least("documents", "m")).drop("m")


def pair_documents(units: DataFrame, keep: DataFrame, distance: int = DEFAULT.pair_distance) -> DataFrame:
    """(server_id, day, l, r, documents): messages with both units within ``distance``.

    ``keep`` lists the surface units (server_id, term) that can matter, forms of
    at most 320 nodes a community.  Pairing looks at places only, so dropping all
    others first changes no kept pair.  A pair is one string, since Spark makes
    strings distinct by their hash and structs by comparing all of them.
    """
    kept = units.select("server_id", "day", "units").join(listed(keep, "_keep"), "server_id")
    lists = kept.select("server_id", "day", F.filter("units", lambda u: u["content"] & F.array_contains("_keep", u["term"])).alias("u"))
    u = F.col("u")

    def mate(x: Column, y: Column) -> Column:
        fits = (y["start"] - x["end"] <= distance) & (y["term"] != x["term"])
        return F.when(fits, F.concat(F.least(x["term"], y["term"]), F.lit("\n"), F.greatest(x["term"], y["term"])))

    # Units do not overlap, so at most ``distance`` of them start that near.
    near = F.transform(u, lambda x, i: F.array(*[mate(x, F.get(u, i + k)) for k in range(1, distance + 1)]))
    pairs = lists.where(F.size(u) > 1).select("server_id", "day", F.explode(F.array_distinct(F.flatten(near))).alias("p")).where("p is not null")
    counted = pairs.groupBy("server_id", "day", "p").agg(F.count("*").alias("documents"))
    return counted.select("server_id", "day", F.substring_index("p", "\n", 1).alias("l"), F.substring_index("p", "\n", -1).alias("r"), "documents")


def canonical_pairs(pairs: DataFrame, observed: DataFrame, bigrams: DataFrame) -> DataFrame:
    """Pairs under canonical terms; a pair of one term with itself goes."""
    ends = pairs.select("server_id", F.col("l").alias("term")).unionByName(pairs.select("server_id", F.col("r").alias("term"))).distinct()
    words = folded(ends.join(bigrams.select("server_id", "term"), ["server_id", "term"], "left_anti"), observed).where("canonical <> term")
    names = lambda end: words.select("server_id", F.col("term").alias(end), F.col("canonical").alias(f"{end}_c"))
    rows = pairs.join(names("l"), ["server_id", "l"], "left").join(names("r"), ["server_id", "r"], "left")
    rows = rows.withColumns({"l": F.coalesce("l_c", "l"), "r": F.coalesce("r_c", "r")}).where("l <> r")
    return rows.groupBy("server_id", "day", F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).agg(F.sum("documents").alias("documents"))
