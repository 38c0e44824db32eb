"""The topic graph: nodes, edges, families and their daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.config import DEFAULT, Settings
from parlance.functions import text
from parlance.operators.classes import classed
from parlance.operators.lexicon import ln1, log2, ranked, with_word_rate
from parlance.operators.units import folded


def specificity(lift: Column) -> Column:
    return F.least(F.lit(8.0), F.greatest(F.lit(0.0), log2(F.greatest(F.lit(1.0), lift))))


def nodes(inventory: DataFrame, totals: DataFrame, words: DataFrame, classes: DataFrame, aliases: DataFrame, bigrams: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The most interesting words about something, and all qualified bigrams."""
    n = totals.select("server_id", F.col("tokens").alias("n"))
    rows = classed(with_word_rate(inventory.where("kind = 'word'").join(n, "server_id"), words), classes, aliases)
    lift = (F.col("uses") / F.greatest("n", F.lit(1))) / F.greatest("rate", F.lit(1e-8))
    special = (F.col("rate") == 0) | ((F.col("rate") * 1e6 <= settings.max_reference_ppm) & (F.col("lift") >= settings.topic_min_lift))
    rows = rows.withColumn("lift", lift).where(
        (F.col("uses") >= settings.min_word_uses) & (F.col("voices") >= settings.min_voices)
        & F.col("reportable") & ~F.col("scaffolding") & special
    )
    interest = ln1(F.col("uses")) * ln1(F.col("voices")) * (1 + specificity(F.col("lift")))
    top = ranked(rows.withColumn("interest", F.round(interest, 9)), F.desc("interest"), F.desc("term"), top=settings.top_nodes)
    columns = ["server_id", "term", "kind", "uses", "voices", "documents", "lift"]
    known = bigrams.select("server_id", "term", F.coalesce("reference_lift", F.lit(1.0)).alias("lift"))
    pairs = inventory.where("kind = 'bigram'").join(known, ["server_id", "term"])
    return top.select(*columns).unionByName(pairs.select(*columns))


def with_composition(pairs: DataFrame, facts: DataFrame, bigrams: DataFrame, nodes: DataFrame, observed: DataFrame) -> DataFrame:
    """Pairs by day with each bigram beside its component words.

    A component edge has at least the bigram's documents, in all and by day, and
    carries the bigram's association.
    """
    parts = bigrams.select("server_id", F.col("term").alias("phrase"), "association", F.explode(F.array_distinct(F.split("term", " "))).alias("term"))
    parts = folded(parts, observed).select("server_id", "phrase", "association", F.col("canonical").alias("term")).distinct()
    parts = parts.join(nodes.select("server_id", "term"), ["server_id", "term"], "left_semi")
    ends = parts.select("server_id", "phrase", "association", F.least("phrase", "term").alias("l"), F.greatest("phrase", "term").alias("r"))
    days = facts.where("kind = 'bigram'").groupBy("server_id", F.col("term").alias("phrase"), "day").agg(F.sum("documents").alias("made"))
    made = ends.join(days, ["server_id", "phrase"]).select("server_id", "day", "l", "r", "association", "made")
    return pairs.join(made, ["server_id", "day", "l", "r"], "full_outer").select(
        "server_id", "day", "l", "r", "association",
        F.coalesce("documents", F.lit(0)).alias("seen"), F.coalesce("made", F.lit(0)).alias("made"),
    )


def edges(days: DataFrame, nodes: DataFrame, totals: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Gated edges with association and weight."""
    rows = days.groupBy("server_id", "l", "r").agg(
        F.greatest(F.sum("seen"), F.sum("made")).alias("documents"), F.max("association").alias("made_association")
    )
    node = lambda end: nodes.select("server_id", F.col("term").alias(end), F.col("documents").alias(f"{end}_documents"))
    rows = rows.where(F.col("documents") >= settings.min_pair_documents).join(node("l"), ["server_id", "l"]).join(node("r"), ["server_id", "r"])
    rows = rows.join(totals.select("server_id", F.greatest("messages", F.lit(1)).alias("m")), "server_id")
    joint = F.col("documents") / F.col("m")
    alone = F.col("l_documents") / F.col("m") * F.col("r_documents") / F.col("m")
    npmi = log2(joint / F.greatest(alone, F.lit(1e-18))) / F.greatest(F.lit(1e-12), -log2(joint))
    rows = rows.withColumn("association", F.coalesce("made_association", npmi)).where(F.col("association") >= settings.min_association)
    relation = F.when(F.col("made_association").isNotNull(), "composition").otherwise("observed_context")
    return rows.select("server_id", "l", "r", "documents", "association", (F.col("association") * ln1(F.col("documents"))).alias("weight"), relation.alias("relation"))


def strongest(edges: DataFrame, top: int) -> DataFrame:
    """Edges among the strongest ``top`` of either end; ties prefer the larger neighbour."""
    ends = edges.select("server_id", "l", "r", "weight", F.col("l").alias("node"), F.col("r").alias("other")).unionByName(
        edges.select("server_id", "l", "r", "weight", F.col("r").alias("node"), F.col("l").alias("other"))
    )
    kept = ranked(ends, F.desc(F.round("weight", 9)), F.desc("other"), top=top, keys=("server_id", "node")).select("server_id", "l", "r").distinct()
    return edges.join(kept, ["server_id", "l", "r"], "left_semi")


def families(nodes: DataFrame, pruned: DataFrame, found: DataFrame, canonical: DataFrame, observed: DataFrame, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(topics, members): the strongest families, and their units with rank.

    ``found``: the communities (server_id, term, community) of the pruned graph.

    Topics: server_id, topic, label, voices, mentions, place.  Members:
    server_id, topic, label, term, kind, uses, voices, lift, rank, label_visible.
    """
    degree = pruned.select("server_id", F.col("l").alias("term"), "weight").unionByName(pruned.select("server_id", F.col("r").alias("term"), "weight"))
    degree = degree.groupBy("server_id", "term").agg(F.sum("weight").alias("degree"))
    placed = nodes.join(found, ["server_id", "term"], "left").join(degree, ["server_id", "term"], "left")
    # A bigram outside every community stands alone; a single word does not.
    placed = placed.where("community is not null or kind = 'bigram'").withColumn("community", F.coalesce("community", "term"))
    score = ln1(F.col("uses")) * ln1(F.col("voices")) * (1 + specificity(F.col("lift"))) * (1 + F.coalesce("degree", F.lit(0.0)))
    family = Window.partitionBy("server_id", "community")
    placed = placed.withColumns({"n": F.count("*").over(family), "pairs": F.count_if(F.col("kind") == "bigram").over(family), "score": F.round(score, 9)}).where("n >= 2 or pairs > 0")
    placed = placed.withColumn("rank", F.row_number().over(family.orderBy(F.desc("score"), "term")))

    named = placed.groupBy("server_id", "community").agg(
        F.min_by("term", F.when(F.col("kind") == "bigram", F.col("rank"))).alias("phrase"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "term")))), lambda x: x["term"]), " · ").alias("words"),
        F.sum("uses").alias("mentions"),
    )
    voices = canonical.join(placed.select("server_id", "term", "kind", "community"), ["server_id", "term", "kind"]).groupBy("server_id", "community").agg(F.countDistinct("speaker").alias("voices"))
    topics = named.join(voices, ["server_id", "community"]).withColumn("label", F.coalesce("phrase", "words"))
    topics = ranked(topics.withColumn("score", F.round(F.col("mentions") * ln1(F.col("voices")), 9)), F.desc("score"), F.col("label"), top=settings.topics)
    topics = topics.select("server_id", "community", text.slug(F.col("label")).alias("topic"), "label", "voices", "mentions", "place")

    members = placed.join(topics.select("server_id", "community", "topic", "label"), ["server_id", "community"])
    parts = members.where("kind = 'bigram'").select("server_id", "topic", F.explode(F.split("term", " ")).alias("term"))
    nested = folded(parts, observed).select("server_id", "topic", F.col("canonical").alias("term"), F.lit("word").alias("kind"), F.lit(True).alias("nested")).distinct()
    members = members.join(nested, ["server_id", "topic", "term", "kind"], "left").select(
        "server_id", "topic", "label", "term", "kind", "uses", "voices", F.round("lift", 1).alias("lift"), "rank", F.col("nested").isNull().alias("label_visible")
    )
    return topics.drop("community"), members


def topic_series(members: DataFrame, canonical: DataFrame, activity: DataFrame) -> DataFrame:
    """Mentions of each topic on each day of the axis, per 10 000 words."""
    uses = canonical.join(members.select("server_id", "topic", "term", "kind"), ["server_id", "term", "kind"]).groupBy("server_id", "topic", "day").agg(F.sum("uses").alias("uses"))
    axis = members.select("server_id", "topic").distinct().join(activity.select("server_id", "day", "tokens"), "server_id")
    rate = F.coalesce("uses", F.lit(0)) / F.greatest("tokens", F.lit(1)) * 10000
    return axis.join(uses, ["server_id", "topic", "day"], "left").select("server_id", "topic", "day", F.round(rate, 3).alias("value"))


def causal(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Add ``smooth``: weights .58, .29, .13 on a day and the two before it,
    shared out anew where a series begins."""
    w = Window.partitionBy(*keys).orderBy("day")
    before = [F.col(value), F.lag(value, 1).over(w), F.lag(value, 2).over(w)]
    weights = [0.58, 0.29, 0.13]
    total = sum((F.coalesce(b, F.lit(0.0)) * k for b, k in zip(before, weights, strict=True)), F.lit(0.0))
    place = F.row_number().over(w)
    return series.withColumn("smooth", total / F.when(place == 1, 0.58).when(place == 2, 0.58 + 0.29).otherwise(0.58 + 0.29 + 0.13))


def daily_share(series: DataFrame, of: str, group: list[str]) -> DataFrame:
    """Add ``share`` of the day's total (0 if nothing) and the ``day_rank`` of each row."""
    whole = F.sum("smooth").over(Window.partitionBy(*group, "day"))
    rows = series.withColumn("share", F.when(whole > 0, F.col("smooth") / whole).otherwise(0.0))
    return rows.withColumn("day_rank", F.row_number().over(Window.partitionBy(*group, "day").orderBy(F.desc(F.round("share", 9)), of)))


def visible_edges(edges: DataFrame, members: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Edges between shown units, among the strongest of either end, by relative weight."""
    shown = shown_units(members, settings).select("server_id", "term").distinct()
    both = edges.join(shown.withColumnRenamed("term", "l"), ["server_id", "l"], "left_semi").join(shown.withColumnRenamed("term", "r"), ["server_id", "r"], "left_semi")
    kept = strongest(both, settings.visible_links)
    top = F.max("weight").over(Window.partitionBy("server_id"))
    return kept.select("server_id", "l", "r", F.round(F.col("weight") / F.when(top > 0, top).otherwise(1.0), 4).alias("weight"), "documents", "relation")


def edge_series(shown: DataFrame, days: DataFrame, activity: DataFrame) -> DataFrame:
    """Documents of each shown edge on each day of the axis, per 1 000 messages.

    ``days``: pairs by day with composition (server_id, day, l, r, seen, made).
    """
    counts = days.select("server_id", "l", "r", "day", F.greatest("seen", "made").alias("documents"))
    axis = shown.select("server_id", "l", "r").join(activity.select("server_id", "day", "messages"), "server_id")
    value = F.coalesce("documents", F.lit(0)) / F.greatest("messages", F.lit(1)) * 1000
    return axis.join(counts, ["server_id", "l", "r", "day"], "left").select("server_id", "l", "r", "day", F.round(value, 3).alias("value"))


def shown_units(members: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return members.where(F.col("rank") <= settings.topic_units)


def allowed_words(lexicon: DataFrame, members: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(server_id, term): words a circle or a channel may be described by.

    Those of the lexicon, and the shown word units of the topics.
    """
    words = shown_units(members, settings).where("kind = 'word'")
    return lexicon.select("server_id", "term").unionByName(words.select("server_id", "term")).distinct()


def topic_mix(counts: DataFrame, members: DataFrame, key: str, observed: DataFrame, settings: Settings = DEFAULT, top: int | None = None) -> DataFrame:
    """Mentions, share and lift of the topics in each subset, most mentioned first.

    ``counts``: (server_id, ``key``, term, kind, uses) of surface units.  Shares
    are of all topics the subset mentions; ``top`` limits what is returned.
    """
    shown = shown_units(members, settings).select("server_id", "topic", "label", "term", "kind", F.col("uses").alias("all_uses"))
    words = folded(counts.where("kind = 'word'"), observed).withColumn("term", F.col("canonical")).drop("canonical")
    rows = words.unionByName(counts.where("kind = 'bigram'")).join(shown, ["server_id", "term", "kind"]).groupBy("server_id", key, "topic", "label").agg(F.sum("uses").alias("mentions"))
    whole = shown.groupBy("server_id", "topic", "label").agg(F.sum("all_uses").alias("all_mentions"))
    w = Window.partitionBy("server_id", key)
    rows = rows.join(whole, ["server_id", "topic", "label"])
    share, all_share = F.col("mentions") / F.sum("mentions").over(w), F.col("all_mentions") / F.sum("all_mentions").over(w)
    rows = rows.withColumns({"share": share, "lift": F.round(share / F.greatest(all_share, F.lit(1e-9)), 2)}).withColumn("share", F.round("share", 3))
    rows = rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("mentions"), "label", "topic"))).drop("all_mentions")
    return rows if top is None else rows.where(F.col("place") <= top)
