"""Eligible messages, their tokens, and the base facts every report is made of."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.config import DEFAULT, Settings
from parlance.functions import text
from parlance.functions.plans import keep, pieces, planned_size, small

HUMAN_TYPES = ("0", "19", "Default", "Reply")
#: What a feed says about the collection of a community.
COLLECTED = (
    "collector_generated", "channels_skipped_no_access", "member_count", "targets",
    "public_archived_threads", "private_archived_threads", "private_archived_scope",
)


def is_eligible() -> Column:
    """Not a bot's, an ordinary message or reply, with a readable moment."""
    ordinary = F.col("type").isNull() | F.col("type").isin(*HUMAN_TYPES)
    return ~F.coalesce("is_bot", F.lit(False)) & ordinary & F.try_to_timestamp("timestamp").isNotNull()


def dated(messages: DataFrame) -> DataFrame:
    return messages.withColumns({"day": F.to_date("ts"), "week": F.to_date(F.date_trunc("week", "ts"))})


def readable(messages: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Human messages with ``ts`` and ``speaker``; columns in ``more`` stay."""
    return messages.where(F.col("server_id").isNotNull() & is_eligible()).select(
        "id", "server_id", "server", "user", "message", *more,
        F.coalesce(F.nullif("channel", F.lit("")), F.lit("?")).alias("channel"),
        F.coalesce(F.nullif("user_id", F.lit("")), F.concat(F.lit("display:"), F.coalesce(F.nullif("user", F.lit("")), F.lit("?")))).alias("speaker"),
        F.try_to_timestamp("timestamp").alias("ts"),
    )


def eligible(messages: DataFrame, settings: Settings = DEFAULT, more: tuple[str, ...] = ()) -> DataFrame:
    """Human messages with ``ts``, ``day``, ``week``, ``speaker`` and ``is_current``; columns in ``more`` stay.

    The current window reaches ``days - 1`` days back from the community's last
    message, to the instant.
    """
    named = readable(messages, more)
    last = named.groupBy("server_id").agg(F.max("ts").alias("last_ts"))
    return dated(
        named.join(small(last), "server_id").withColumn("is_current", F.col("ts") >= F.timestamp_add("DAY", F.lit(1 - settings.days), F.col("last_ts")))
    )


def worded(messages: DataFrame) -> DataFrame:
    """``tokens`` and ``breaks`` in place of the text."""
    cleaned = messages.withColumn("message", text.clean(F.col("message")))
    return cleaned.withColumns({"tokens": text.word_tokens(F.col("message")), "breaks": text.breaks(F.col("message"))}).drop("message")


def tokenized(messages: DataFrame, settings: Settings = DEFAULT, more: tuple[str, ...] = ()) -> DataFrame:
    """Eligible messages with ``tokens`` and ``breaks`` in place of the text; columns in ``more`` stay."""
    return worded(eligible(messages, settings, more))


def member_aliases(messages: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """(server_id, alias): words of the names of authors and listed members."""
    names = messages.where(F.col("server_id").isNotNull() & is_eligible()).select("server_id", F.col("user").alias("name")).distinct()
    if roster is not None:
        listed = roster.select("server_id", F.explode(F.array("nick", "user.global_name", "user.username")).alias("name"))
        names = names.unionByName(listed)
    return names.select("server_id", F.explode(text.aliases(F.col("name"))).alias("alias")).distinct()


def occurrences(tokens: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), more: tuple[str, ...] = ()) -> DataFrame:
    """One row per word, valid bigram and valid trigram; columns in ``more`` stay."""
    keys = ["server_id", "speaker", "channel", "day", "week", "is_current", "ts", *more]
    rows = tokens.select(*keys, text.places(F.col("tokens"), F.col("breaks")))
    terms = [F.struct(F.lit(n).alias("size"), text.gram(n).alias("term")) for n in sizes]
    return rows.select(*keys, F.inline(F.array(*terms))).where("term is not null")


def term_facts(tokens: DataFrame, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The base facts: uses by term, speaker, channel and day.

    This is the one large shuffle; all inventories roll it up.
    """
    keys = ["server_id", "size", "term", "speaker", "channel", "day", "week", "is_current"]
    return occurrences(tokens, sizes).groupBy(*keys).agg(F.count("*").alias("uses"), F.min("ts").alias("first_ts"))


TERM = ("server_id", "size", "term")


def inventory(facts: DataFrame, current: bool) -> DataFrame:
    """Uses, voices, active days and first moment of each term.

    Facts move once, to their term; speakers and days are told apart there.
    """
    rows = (facts.where("is_current") if current else facts).repartition(*TERM)
    none, day = F.lit(None).cast("long"), F.lit(None).cast("date")
    voice = F.struct("speaker", day.alias("day"), "uses", "first_ts")
    date = F.struct(F.lit(None).cast("string").alias("speaker"), F.col("day").alias("day"), none.alias("uses"), F.lit(None).cast("timestamp").alias("first_ts"))
    apart = rows.select(*TERM, F.inline(F.array(voice, date))).groupBy(*TERM, "speaker", "day").agg(F.sum("uses").alias("uses"), F.min("first_ts").alias("first_ts"))
    return apart.groupBy(*TERM).agg(F.sum("uses").alias("uses"), F.count("speaker").alias("voices"), F.count("day").alias("active_days"), F.min("first_ts").alias("first_ts"))


def phrase_inventory(tokens: DataFrame, least: int, sizes: tuple[int, ...] = (2, 3), hold: Callable[[DataFrame], DataFrame] = keep) -> DataFrame:
    """``inventory`` of the phrases with ``least`` uses, of kept tokens.  Occurrences move to their term, once."""

    def each(chosen: Column) -> DataFrame:
        rows = occurrences(tokens, sizes).where(chosen).select(*TERM, "speaker", "day", F.lit(1).cast("long").alias("uses"), F.col("ts").alias("first_ts"))
        return inventory(rows, False).where(F.col("uses") >= least)

    return reduce(DataFrame.unionByName, pieces(planned_size(tokens), each, "server_id", "term", hold=hold))


def history_terms(tokens: DataFrame, settings: Settings = DEFAULT, hold: Callable[[DataFrame], DataFrame] = keep) -> DataFrame:
    """Uses, voices, first moment, and uses in the last weeks and in as many before, of every word and every repeated phrase.

    ``tokens`` of the whole history, kept.  Words are summed by speaker before they
    move; of phrases, most of them rare, occurrences move to their term, once.
    """
    n, last = settings.trend_weeks, tokens.groupBy("server_id").agg(F.max("week").alias("last_week"))
    age = (F.datediff("last_week", "week") / 7).cast("int")
    told = tokens.join(small(last), "server_id").withColumn("period", F.when(age < n, 0).when(age < 2 * n, 1))

    def each(rows: DataFrame) -> DataFrame:
        of = lambda k: F.count_if(F.col("period") == k)
        one = rows.groupBy(*TERM, "speaker").agg(F.count("*").alias("uses"), F.min("ts").alias("first_ts"), of(0).alias("recent_uses"), of(1).alias("previous_uses"))
        sums = [F.sum(c).alias(c) for c in ("uses", "recent_uses", "previous_uses")]
        return one.groupBy(*TERM).agg(*sums, F.count("*").alias("voices"), F.min("first_ts").alias("first_ts"))

    def phrases(chosen: Column) -> DataFrame:
        rows = occurrences(told, (2, 3), ("period",)).where(chosen).select(*TERM, "speaker", "ts", "period").repartition(*TERM)
        return each(rows).where(F.col("uses") >= min(settings.min_phrase_uses, settings.min_word_uses))

    return reduce(DataFrame.unionByName, [each(occurrences(told, (1,), ("period",))), *pieces(planned_size(tokens), phrases, "server_id", "term", hold=hold)])


def roll_up(facts: DataFrame, *keys: str, current: bool = True) -> DataFrame:
    rows = facts.where("is_current") if current else facts
    return rows.groupBy("server_id", *keys).agg(F.sum("uses").alias("uses"))


def totals(tokens: DataFrame, current: bool = True) -> DataFrame:
    """Messages, tokens, voices and channels of each community."""
    rows = tokens.where("is_current") if current else tokens
    return rows.groupBy("server_id").agg(
        F.count("*").alias("messages"), F.sum(F.size("tokens")).alias("tokens"), F.countDistinct("speaker").alias("voices"),
        F.countDistinct("channel").alias("channels"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def day_axis(tokens: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Every day of the window up to the date of the last message."""
    last = tokens.groupBy("server_id").agg(F.to_date(F.max("ts")).alias("d"))
    return last.select("server_id", F.explode(F.sequence(F.date_sub("d", settings.days - 1), F.col("d"))).alias("day"))


def daily_activity(tokens: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    seen = tokens.where("is_current").groupBy("server_id", "day").agg(
        F.count("*").alias("messages"), F.sum(F.size("tokens")).alias("tokens"), F.countDistinct("speaker").alias("voices")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return day_axis(tokens, settings).join(seen, ["server_id", "day"], "left").select("server_id", "day", zero("messages"), zero("tokens"), zero("voices"))


def heat_map(tokens: DataFrame) -> DataFrame:
    """Messages by weekday (Monday 0) and hour, all 168 cells of each community."""
    cells = tokens.select("server_id").distinct().select("server_id", F.explode(F.sequence(F.lit(0), F.lit(167))).alias("c"))
    grid = cells.select("server_id", F.floor(F.col("c") / 24).cast("int").alias("weekday"), (F.col("c") % 24).alias("hour"))
    seen = tokens.where("is_current").groupBy("server_id", F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return grid.join(seen, ["server_id", "weekday", "hour"], "left").select("server_id", "weekday", "hour", F.coalesce("n", F.lit(0)).alias("messages"))


def people_activity(tokens: DataFrame) -> DataFrame:
    """Last display name, messages, share, tokens, active days and channels of each speaker."""
    rows = tokens.where("is_current").groupBy("server_id", "speaker").agg(
        F.max_by(F.coalesce("user", F.lit("?")), F.struct("ts", "id")).alias("name"), F.count("*").alias("messages"),
        F.sum(F.size("tokens")).alias("tokens"), F.countDistinct("day").alias("active_days"), F.countDistinct("channel").alias("channels"),
    )
    whole = rows.groupBy("server_id").agg(F.sum("messages").alias("all_messages"))
    return rows.join(whole, "server_id").withColumn("share", F.round(F.col("messages") / F.greatest("all_messages", F.lit(1)), 4)).drop("all_messages")


def message_links(messages: DataFrame) -> DataFrame:
    """One row a link of the current window with its domain; needs eligible messages."""
    links = messages.where("is_current").select("server_id", "speaker", "day", "ts", F.posexplode(F.regexp_extract_all("message", F.lit(f"(?i)({text.LINK})"), 1)).alias("at", "link"))
    return links.withColumn("domain", text.domain(F.col("link"))).where("domain is not null")


def link_domains(messages: DataFrame, top: int | None = None) -> DataFrame:
    """Uses, voices and days of each link domain; with ``top``, of the most used (the first seen of equals)."""
    named = message_links(messages)
    found = named.groupBy("server_id", "domain").agg(
        F.count("*").alias("uses"), F.countDistinct("speaker").alias("voices"), F.countDistinct("day").alias("active_days"), F.min(F.struct("ts", "at")).alias("first")
    )
    if top is not None:
        order = Window.partitionBy("server_id").orderBy(F.desc("uses"), "first", "domain")
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return found.drop("first")


def domain_series(messages: DataFrame, axis: DataFrame, top: int = 20) -> DataFrame:
    """Uses of the ``top`` domains on each day of ``axis`` (server_id, day)."""
    shown = link_domains(messages, top).select("server_id", "domain")
    uses = message_links(messages).groupBy("server_id", "domain", "day").agg(F.count("*").alias("n"))
    rows = shown.join(axis.select("server_id", "day"), "server_id").join(uses, ["server_id", "domain", "day"], "left")
    return rows.select("server_id", "domain", "day", F.coalesce("n", F.lit(0)).cast("long").alias("uses"))


def symbols(messages: DataFrame, top: int | None = None) -> DataFrame:
    """Custom emoji, emoji characters, reactions and media, by total; with ``top``, the most used only."""
    some = F.array().cast("array<string>")
    custom = F.regexp_extract_all("message", F.lit(text.CUSTOM_EMOJI), 1)
    characters = F.regexp_extract_all("message", F.lit(f"({text.EMOJI})"), 1)
    typed = messages.select("server_id", F.explode(F.concat(F.coalesce(custom, some), F.coalesce(characters, some))).alias("symbol"), F.lit(1).cast("long").alias("n"))
    reacted = messages.select("server_id", F.inline("reactions")).select("server_id", F.coalesce(F.nullif("emoji", F.lit("")), F.lit("?")).alias("symbol"), F.coalesce("count", F.lit(0)).alias("n"))
    media = messages.where(F.size("attachments") > 0).select("server_id", F.lit("media attachment").alias("symbol"), F.lit(1).cast("long").alias("n"))
    found = typed.unionByName(reacted).unionByName(media).groupBy("server_id", "symbol").agg(F.sum("n").alias("uses"))
    if top is None:
        return found
    order = Window.partitionBy("server_id").orderBy(F.desc("uses"), "symbol")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def side_bar(messages: DataFrame) -> DataFrame:
    """Messages in all, by community, and by community and channel."""
    return messages.rollup("server", "channel").agg(F.count("*").alias("messages"), F.grouping_id().alias("level"))


def search(messages: DataFrame, query: str, server: str | None = None, channel: str | None = None) -> DataFrame:
    q = F.lit(query.lower())
    found = F.coalesce(F.contains(F.lower("message"), q), F.lit(False)) | F.coalesce(F.contains(F.lower("user"), q), F.lit(False))
    for name, value in (("server", server), ("channel", channel)):
        if value is not None:
            found &= F.col(name) == value
    return messages.where(found)


def coverage(messages: DataFrame) -> DataFrame:
    """Stored and eligible records by community; those without one are counted under null."""
    return messages.groupBy("server_id").agg(F.count("*").alias("stored"), F.count_if(is_eligible()).alias("eligible"))


def skipped_records(messages: DataFrame) -> DataFrame:
    """How many stored records no report can use, by reason; the first that holds counts."""
    reason = (
        F.when(F.col("server_id").isNull() | (F.col("server_id") == ""), "no community")
        .when(F.coalesce("is_bot", F.lit(False)), "bot")
        .when(F.try_to_timestamp("timestamp").isNull(), "no readable moment")
        .when(~is_eligible(), "not a message or reply")
    )
    return messages.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("records"))


def collection_coverage(messages: DataFrame, servers: DataFrame) -> DataFrame:
    """``coverage`` with what the collector says of each community.

    ``servers``: the feed's (generated, channels_skipped_no_access, id,
    member_count, coverage); ids stand there without the platform's prefix.
    """
    said = servers.select(
        F.col("id").alias("bare"), F.col("generated").alias("collector_generated"), "channels_skipped_no_access", "member_count",
        "coverage.targets", "coverage.public_archived_threads", "coverage.private_archived_threads", "coverage.private_archived_scope",
    ).groupBy("bare").agg(*[F.max_by(c, "collector_generated").alias(c) for c in COLLECTED])
    own = coverage(messages).where("server_id is not null").withColumn("bare", F.regexp_replace("server_id", "^discord:", ""))
    return own.join(said, "bare", "left").drop("bare")


def server_index(messages: DataFrame, primary: str | None = None) -> DataFrame:
    """Name of the latest eligible record, counts and place, the primary community first."""
    rows = coverage(messages).where("server_id is not null and eligible > 0")
    last = messages.where(F.col("server_id").isNotNull() & is_eligible()).groupBy("server_id").agg(
        F.max_by("server", F.struct(F.try_to_timestamp("timestamp"), "id")).alias("name")
    )
    first = F.desc(F.col("server_id") == primary) if primary else F.lit(0)
    return rows.join(last, "server_id").withColumn("place", F.row_number().over(Window.orderBy(first, F.desc("stored"), "server_id")))
