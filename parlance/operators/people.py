"""Who talks where: affinity, conversation circles, channel profiles, keys."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.plans import forget, keep
from parlance.operators.lexicon import ln1, log2, ranked


def person_key(speaker: Column) -> Column:
    """A short pseudonym: the 6-byte BLAKE2b digest in hex."""
    digest = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=6).hexdigest()), "string")
    return digest(speaker)


def participation(tokens: DataFrame) -> DataFrame:
    """Messages of each speaker in each channel, and the first of them (moment, id)."""
    return tokens.where("is_current").groupBy("server_id", "speaker", "channel").agg(F.count("*").alias("messages"), F.min(F.struct("ts", "id")).alias("first"))


def rooms_of_regulars(participation: DataFrame, least: int = 3) -> DataFrame:
    """Participation of people with ``least`` messages, in rooms of two or more of them.

    With ``members`` of the room, and ``broad``, by which its breadth divides a link.
    """
    total = Window.partitionBy("server_id", "speaker")
    rows = participation.withColumn("all", F.sum("messages").over(total)).where(F.col("all") >= least)
    breadth = rows.groupBy("server_id", "channel").agg(F.count("*").alias("members")).where("members >= 2")
    rows = rows.join(breadth, ["server_id", "channel"])
    return rows.select("server_id", "channel", "speaker", "messages", "members", log2(2 + F.col("members")).alias("broad"))


def salted(left: DataFrame, right: DataFrame, salts: int) -> DataFrame:
    """Rows of the same room put together; a room of any breadth is the work of many tasks."""
    left = left.withColumn("salt", F.pmod(F.hash("l"), F.lit(salts)))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["server_id", "channel", "salt"])


def affinity(participation: DataFrame, least: int = 3, salts: int = 16) -> DataFrame:
    """Weight of all two people who share channels; broad rooms count less.

    Every pair of a room is a row here: ``strongest_links`` finds the links that a
    graph of people keeps without them.
    """
    rows = rooms_of_regulars(participation, least)
    left = rows.select("server_id", "channel", "broad", F.col("speaker").alias("l"), F.col("messages").alias("a"))
    right = rows.select("server_id", "channel", F.col("speaker").alias("r"), F.col("messages").alias("b"))
    met = salted(left, right, salts).where("l < r")
    return met.groupBy("server_id", "l", "r").agg(F.sum(F.sqrt(F.col("a") * F.col("b")) / F.col("broad")).alias("weight"))


def heads(rooms: DataFrame, depth: int) -> DataFrame:
    """The ``depth`` busiest people of each room; Spark drops the others before the shuffle."""
    return ranked(rooms, F.desc("messages"), F.desc("speaker"), top=depth, keys=("server_id", "channel"))


def candidates(asking: DataFrame, first: DataFrame, salts: int = 16) -> DataFrame:
    """(server_id, l, r): people who ask, with everyone at the head of their rooms."""
    left = asking.select("server_id", "channel", F.col("speaker").alias("l"))
    right = first.select("server_id", "channel", F.col("speaker").alias("r"))
    return salted(left, right, salts).where("l <> r").select("server_id", "l", "r").distinct()


def strongest_links(participation: DataFrame, top: int = 8, least: int = 3, depth: int = 64, growth: int = 8) -> DataFrame:
    """(server_id, l, r, weight): the links of ``affinity`` among the ``top`` of either end.

    A threshold search: each person meets the ``depth`` busiest people of each of
    their rooms, and the weight of these links is summed over all shared rooms.
    Someone not met stands behind the last of the head in every shared room, so the
    sum of the person's roots with these last ones bounds any other link.  Who has
    ``top`` links beyond that bound is done; the others ask again, deeper.  Of links
    of equal weight (to nine places) the larger name counts, and an equal one that
    was not met has a smaller name than the last of each head.

    A first round makes ``depth`` pairs a row of participation, however broad the
    rooms; only people whose bound is too near go on.
    """
    spark = participation.sparkSession
    rooms = keep(rooms_of_regulars(participation, least))
    asking, out = rooms, []
    while True:
        first = keep(heads(rooms, depth).select("server_id", "channel", "speaker", "messages", "place"))
        ends = lambda name, n: rooms.select("server_id", "channel", F.col("speaker").alias(name), F.col("messages").alias(n), "broad")
        shared = candidates(asking, first).join(ends("l", "a"), ["server_id", "l"]).join(ends("r", "b").drop("broad"), ["server_id", "r", "channel"])
        weighed = shared.groupBy("server_id", "l", "r").agg(F.sum(F.sqrt(F.col("a") * F.col("b")) / F.col("broad")).alias("weight"))
        best = keep(ranked(weighed, F.desc(F.round("weight", 9)), F.desc("r"), top=top, keys=("server_id", "l")))
        last = first.where(F.col("place") == depth).select("server_id", "channel", F.col("messages").alias("b"), F.col("speaker").alias("behind"))
        beyond = asking.where(F.col("members") > depth).join(last, ["server_id", "channel"])
        bound = beyond.groupBy("server_id", F.col("speaker").alias("l")).agg(F.sum(F.sqrt(F.col("messages") * F.col("b")) / F.col("broad")).alias("bound"), F.min("behind").alias("behind"))
        worst = best.where(F.col("place") == top).select("server_id", "l", F.round("weight", 9).alias("weight"), "r")
        limit = F.round("bound", 9)
        proved = F.coalesce((F.col("weight") > limit) | ((F.col("weight") == limit) & (F.col("r") >= F.col("behind"))), F.lit(False))
        open_ = keep(bound.join(worst, ["server_id", "l"], "left").where(~proved).select("server_id", F.col("l").alias("speaker")))
        out.append(best.join(open_.withColumnRenamed("speaker", "l"), ["server_id", "l"], "left_anti"))
        if open_.isEmpty():
            break
        asking, depth = rooms.join(open_, ["server_id", "speaker"], "left_semi"), depth * growth
    every = reduce(DataFrame.unionByName, out)
    found = keep(every.groupBy("server_id", F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).agg(F.max("weight").alias("weight")))
    forget(spark, rooms)
    return found


def circles(found: DataFrame, people: DataFrame, top: int = 6) -> DataFrame:
    """(server_id, circle, speaker, name, messages): the largest groups of people.

    ``found``: the communities (server_id, term, community) of the graph of people.
    """
    rows = found.withColumnRenamed("term", "speaker").join(people.select("server_id", "speaker", "name", "messages"), ["server_id", "speaker"])
    groups = rows.groupBy("server_id", "community").agg(F.count("*").alias("n"), F.sum("messages").alias("m")).where("n >= 2")
    groups = ranked(groups, F.desc("m"), F.col("community"), top=top, name="circle")
    return rows.join(groups.select("server_id", "community", "circle"), ["server_id", "community"]).select("server_id", "circle", "speaker", "name", "messages")


def circle_channels(circles: DataFrame, participation: DataFrame, top: int = 5) -> DataFrame:
    """A circle's channels by messages squared over the channel's messages."""
    whole = participation.groupBy("server_id", "channel").agg(F.sum("messages").alias("all_messages"))
    rows = participation.join(circles.select("server_id", "circle", "speaker"), ["server_id", "speaker"]).groupBy("server_id", "circle", "channel").agg(F.sum("messages").alias("messages"))
    rows = rows.join(whole, ["server_id", "channel"]).withColumn("score", F.round(F.col("messages") * F.col("messages") / F.greatest("all_messages", F.lit(1)), 9))
    return ranked(rows, F.desc("score"), F.col("channel"), top=top, keys=("server_id", "circle")).select("server_id", "circle", "place", "channel", "messages")


def circle_labels(channels: DataFrame, mix: DataFrame, top: int = 5) -> DataFrame:
    """#first channel · first part of the most characteristic topic's label.

    ``mix``: (server_id, circle, label, mentions, lift, place); the ``top`` topics compete.
    """
    score = F.round(ln1(F.col("mentions")) * (1 + F.greatest(F.lit(0.0), log2(F.greatest("lift", F.lit(1e-9))))), 9)
    topic = mix.where(F.col("place") <= top).groupBy("server_id", "circle").agg(F.max_by("label", F.struct(score, "label")).alias("topic"))
    first = channels.where("place = 1").select("server_id", "circle", "channel")
    name = F.coalesce(F.substring_index("topic", " · ", 1), F.lit("conversation"))
    return first.join(topic, ["server_id", "circle"], "left").select("server_id", "circle", F.concat(F.lit("#"), "channel", F.lit(" · "), name).alias("label"))


def circle_words(facts: DataFrame, people: DataFrame, circles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, sizes) of each circle, as ``distinctive`` takes them."""
    groups = circles.select("server_id", "circle", "speaker")
    words = facts.where("is_current and size = 1").groupBy("server_id", "speaker", "term").agg(F.sum("uses").alias("uses")).join(groups, ["server_id", "speaker"])
    counts = words.groupBy("server_id", "circle", "term").agg(F.sum("uses").alias("uses"), F.count("*").alias("voices"))
    counts = counts.join(groups.groupBy("server_id", "circle").agg(F.count("*").alias("members")), ["server_id", "circle"])
    sizes = groups.join(people.select("server_id", "speaker", "tokens"), ["server_id", "speaker"]).groupBy("server_id", "circle").agg(F.sum("tokens").alias("size"))
    return counts, sizes


def unit_counts(unit_facts: DataFrame, key: str, groups: DataFrame | None = None) -> DataFrame:
    """(server_id, key, term, kind, uses) of surface units by speaker, channel or group of speakers."""
    rows = unit_facts if groups is None else unit_facts.join(groups.select("server_id", key, "speaker"), ["server_id", "speaker"])
    return rows.groupBy("server_id", key, "term", "kind").agg(F.sum("uses").alias("uses"))


def nested(rows: DataFrame, key: str, name: str, *fields: str) -> DataFrame:
    """Rows of each (server_id, key) as one array of structs, in the order of ``place``.

    For short lists only: ``place`` is limited before.
    """
    item = F.struct(*fields)
    listed = rows.groupBy("server_id", key).agg(F.array_sort(F.collect_list(F.struct("place", item.alias("item")))).alias("l"))
    return listed.select("server_id", key, F.transform("l", lambda x: x["item"]).alias(name))


def people_table(people: DataFrame, participation: DataFrame, mix: DataFrame, contributions: DataFrame, channels: int = 5, topics: int = 6) -> DataFrame:
    """One row a speaker: activity, busiest channels, topics, and uses of published terms.

    Ties among channels keep the order in which they were first used.
    """
    rooms = ranked(participation, F.desc("messages"), F.col("first"), F.col("channel"), top=channels, keys=("server_id", "speaker"))
    rooms = nested(rooms, "speaker", "top_channels", "channel", "messages")
    about = nested(mix.where(F.col("place") <= topics), "speaker", "topics", "topic", "label", "mentions", "share", "lift")
    uses = lambda kind: F.map_from_entries(F.sort_array(F.collect_list(F.when(kind, F.struct("term", "uses")))))
    said = contributions.groupBy("server_id", "speaker").agg(uses(F.col("size") == 1).alias("words"), uses(F.col("size") > 1).alias("phrases"))
    rows = people.withColumnRenamed("channels", "n_channels")
    for part in (rooms, about, said):
        rows = rows.join(part, ["server_id", "speaker"], "left")
    none = {"top_channels": F.array(), "topics": F.array(), "words": F.create_map(), "phrases": F.create_map()}
    return rows.withColumns({c: F.coalesce(c, v.cast(rows.schema[c].dataType)) for c, v in none.items()})


def distinctive(counts: DataFrame, key: str, sizes: DataFrame, words: DataFrame, allowed: DataFrame, totals: DataFrame, voices: bool, top: int = 8) -> DataFrame:
    """Terms used more in a subset than in the rest of its community.

    ``counts``: (server_id, key, term, uses[, voices, members]); ``sizes``:
    (server_id, key, size) tokens of the subset; ``words``: community totals.
    """
    rows = counts.join(allowed.select("server_id", "term").distinct(), ["server_id", "term"], "left_semi").where("uses >= 3")
    if voices:
        rows = rows.where(F.col("voices") >= F.least(F.lit(2), F.col("members")))
    rows = rows.join(words.select("server_id", "term", F.col("uses").alias("all_uses")), ["server_id", "term"]).join(sizes, ["server_id", key])
    rows = rows.join(totals.select("server_id", F.col("tokens").alias("n")), "server_id")
    here = (F.col("uses") + 0.5) / (F.col("size") + 1000)
    rest = (F.col("all_uses") - F.col("uses") + 0.5) / (F.greatest(F.lit(0), F.col("n") - F.col("size")) + 1000)
    rows = rows.withColumn("lift", here / rest)
    score = ln1(F.col("uses")) * log2(F.col("lift") + 1) * (ln1(F.col("voices")) if voices else F.lit(1.0))
    order = (F.desc(F.round("score", 9)), F.desc("uses"), F.col("term"))
    kept = ranked(rows.withColumn("score", score), *order, top=top, keys=("server_id", key))
    return kept.select("server_id", key, "place", "term", "uses", *(["voices"] if voices else []), F.round("lift", 1).alias("lift"))


def busiest_channels(participation: DataFrame, top: int = 10) -> DataFrame:
    """The channels with most messages; ties keep the order of their first message."""
    rooms = participation.groupBy("server_id", "channel").agg(F.sum("messages").alias("messages"), F.count("*").alias("voices"), F.min("first").alias("first"))
    return ranked(rooms, F.desc("messages"), F.col("first"), F.col("channel"), top=top).drop("first")


def channel_people(rooms: DataFrame, participation: DataFrame, people: DataFrame, shown: int = 6) -> DataFrame:
    """(server_id, channel, place, speaker, name, messages): the busiest people of each room."""
    rows = participation.join(rooms.select("server_id", "channel"), ["server_id", "channel"], "left_semi").join(people.select("server_id", "speaker", "name"), ["server_id", "speaker"])
    best = ranked(rows, F.desc("messages"), F.col("name"), F.col("speaker"), top=shown, keys=("server_id", "channel"))
    return best.select("server_id", "channel", "place", "speaker", "name", "messages")


def channel_profiles(participation: DataFrame, people: DataFrame, mix: DataFrame | None = None, language: DataFrame | None = None, top: int = 10, topics: int = 4) -> DataFrame:
    """The busiest channels with voices, busiest people, topics and distinctive words.

    ``mix``: topic mix by channel; ``language``: distinctive words by channel.
    """
    rooms = busiest_channels(participation, top)
    rows = rooms.join(nested(channel_people(rooms, participation, people), "channel", "people", "name", "messages"), ["server_id", "channel"])
    if mix is not None:
        rows = rows.join(nested(mix.where(F.col("place") <= topics), "channel", "topics", "topic", "label", "mentions", "share", "lift"), ["server_id", "channel"], "left")
    if language is not None:
        rows = rows.join(nested(language, "channel", "language", "term", "uses", "lift"), ["server_id", "channel"], "left")
    return rows


def circle_table(circles: DataFrame, channels: DataFrame, labels: DataFrame, mix: DataFrame, language: DataFrame, totals: DataFrame, topics: int = 5) -> DataFrame:
    """One row a circle: label, messages, share, members, channels, topics and distinctive words."""
    order = Window.partitionBy("server_id", "circle").orderBy(F.desc("messages"), "name", "speaker")
    members = circles.withColumns({"key": person_key(F.col("speaker")), "place": F.row_number().over(order)})
    sizes = circles.groupBy("server_id", "circle").agg(F.sum("messages").alias("messages"))
    rows = sizes.join(totals.select("server_id", F.col("messages").alias("all_messages")), "server_id")
    rows = rows.withColumn("share", F.round(F.col("messages") / F.greatest("all_messages", F.lit(1)), 3)).drop("all_messages").join(labels, ["server_id", "circle"], "left")
    parts = (
        nested(members, "circle", "members", "key", "name", "messages"), nested(channels, "circle", "channels", "channel", "messages"),
        nested(mix.where(F.col("place") <= topics), "circle", "topics", "topic", "label", "mentions", "share", "lift"),
        nested(language, "circle", "language", "term", "uses", "voices", "lift"),
    )
    for part in parts:
        rows = rows.join(part, ["server_id", "circle"], "left")
    return rows


def pseudonymous(people: DataFrame) -> DataFrame:
    """People under their key, most messages first, without platform ids."""
    order = Window.partitionBy("server_id").orderBy(F.desc("messages"), F.lower("name"), "key")
    return people.withColumn("key", person_key(F.col("speaker"))).drop("speaker").withColumn("place", F.row_number().over(order))


