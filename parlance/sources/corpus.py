"""The canonical history: monthly partitions of messages, unique by id."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance import schemas
from parlance.functions import text
from parlance.functions.plans import keep, swept
from parlance.sources import files


def month_of(timestamp: Column) -> Column:
    """First seven characters of the raw stamp, or ``undated``."""
    return F.when((F.length(timestamp) >= 7) & (F.substring(timestamp, 5, 1) == "-"), F.left(timestamp, F.lit(7))).otherwise("undated")


def require_ids(df: DataFrame) -> DataFrame:
    """Fail on a row without an id."""
    ok = F.col("id").isNotNull() & (F.col("id") != "")
    return df.withColumn("id", F.when(ok, F.col("id")).otherwise(F.raise_error(F.lit("a canonical record has no id"))))


def normalize(raw: DataFrame, platform: str = "discord") -> DataFrame:
    """Raw platform messages, with server, channel and thread columns, as canonical rows.

    Adds to raw columns: guild_id, guild_name, channel_id, channel_name,
    target_id, thread_id, thread_name.
    """
    tag = lambda c: F.concat(F.lit(f"{platform}:"), c)
    files = F.transform(
        F.coalesce("attachments", F.array()),
        lambda a: F.struct(a["filename"].alias("name"), a["url"].alias("url"), a["size"].alias("bytes"), F.lit(None).cast("string").alias("file")),
    )
    marks = F.transform("reactions", lambda r: F.struct(r["emoji"]["name"].alias("emoji"), r["count"].alias("count")))
    return raw.select(
        tag(F.col("id")).alias("id"), "timestamp", tag(F.col("guild_id")).alias("server_id"), F.col("guild_name").alias("server"),
        tag(F.col("channel_id")).alias("channel_id"), F.col("channel_name").alias("channel"), tag(F.col("thread_id")).alias("thread_id"),
        F.col("thread_name").alias("thread"), tag(F.col("author.id")).alias("user_id"),
        F.coalesce(F.nullif("author.global_name", F.lit("")), "author.username", F.lit("?")).alias("user"),
        F.coalesce("author.bot", F.lit(False)).alias("is_bot"),
        text.redact(text.resolve_mentions(F.col("content"), F.col("mentions"))).alias("message"),
        tag(F.col("message_reference.message_id")).alias("reply_to"),
        F.concat_ws("/", F.lit(f"https://{platform}.com/channels"), "guild_id", "target_id", "id").alias("url"), F.lit(platform).alias("platform"),
        F.when(~F.col("type").isin(0, 19), F.col("type").cast("string")).alias("type"), files.alias("attachments"),
        F.when(F.size("reactions") > 0, marks).alias("reactions"),
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows with ``month``; malformed lines fail."""
    return spark.read.schema(schemas.MESSAGE + ", month STRING").option("mode", "FAILFAST").json(path)


def unique_history(stored: DataFrame, server_id: str | None = None, server: str | None = None) -> DataFrame:
    """One row per id, the earliest partition's, after the server filter."""
    rows = require_ids(stored)
    if server_id:
        rows = rows.where(F.col("server_id") == server_id)
    if server:
        rows = rows.where(F.col("server") == server)
    first = Window.partitionBy("id").orderBy("month", "timestamp")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def url_path(url: Column) -> Column:
    """Path of a link: an attachment's identity, whatever its signed query."""
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def known_files(versions: DataFrame) -> DataFrame:
    """(month, id, n, files): for each version, by path, the local files its predecessor knew.

    ``versions``: (month, id, n, attachments).  A file goes on from version to version
    as long as each has an attachment of that path: with a file of its own in the last
    one of these a version names it anew, else it is the one known, or the last named.
    """
    item = versions.select("month", "id", "n", F.posexplode("attachments").alias("at", "a"))
    file = F.nullif(F.col("a")["file"], F.lit(""))
    item = item.select("month", "id", "n", "at", url_path(F.col("a")["url"]).alias("path"), file.alias("file"))
    named = item.groupBy("month", "id", "n", "path").agg(F.max_by("file", "at").alias("last"), F.max_by("file", F.when(F.col("file").isNotNull(), F.col("at"))).alias("own"))
    of = Window.partitionBy("month", "id", "path").orderBy("n")
    named = named.withColumn("run", F.col("n") - F.row_number().over(of))
    run = Window.partitionBy("month", "id", "path", "run").orderBy("n")
    named = named.withColumn("since", F.count("last").over(run))
    told = Window.partitionBy("month", "id", "path", "run", "since").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = named.withColumn("file", F.first(F.coalesce("last", "own"), ignorenulls=True).over(told))
    before = named.withColumn("file", F.lag("file").over(run)).where("file is not null")
    return before.groupBy("month", "id", "n").agg(F.map_from_entries(F.collect_list(F.struct("path", "file"))).alias("files"))


def merge(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert a batch: (all rows after it with ``month``, receipt by month).

    ``incoming`` has ``seq``, the order in the batch, unlike for each version of an id.  A repeat counts against the
    version before it; the last one stays.  Attachments keep the local files that
    the version before knew by their path.

    Versions are counted and compared by slim rows with a digest of the record (SHA-256
    of its JSON).  Whole records move once, to the range of month and moment they are
    stored in: what a later version replaced travels there as a mark, which takes its
    record out.  So rows come dealt and sorted by month, moment and id.
    """
    columns, first = [c for c in incoming.columns if c != "seq"], F.lit(-(2**63)).cast("long")
    new = require_ids(incoming).select(month_of(F.col("timestamp")).alias("month"), F.coalesce("seq", first).alias("seq"), *columns)
    old = stored.select("month", first.alias("seq"), *columns)
    came = F.col("seq") > first
    if "attachments" in columns:
        number = F.row_number().over(Window.partitionBy("month", "id").orderBy("seq")).alias("n")
        slim = old.unionByName(new).select("month", "id", "seq", "attachments").select("*", number)
        known = known_files(slim).join(slim.select("month", "id", "n", "seq"), ["month", "id", "n"]).groupBy("month", "id", "seq").agg(F.any_value("files").alias("files"))
        # Written, its size is known: few files are sent to the records, which stay where they are.
        new = new.join(keep(known), ["month", "id", "seq"], "left")
        file = lambda a: F.coalesce(F.nullif(a["file"], F.lit("")), F.try_element_at("files", url_path(a["url"])))
        filled = F.transform("attachments", lambda a: a.withField("file", file(a)))
        new = new.withColumn("attachments", F.when(came, filled).otherwise(F.col("attachments"))).drop("files")
    every = old.unionByName(new)
    digest = F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
    order = Window.partitionBy("month", "id").orderBy("seq")
    versions = every.select("month", "id", "seq", "timestamp", digest.alias("digest")).withColumns({"before": F.lag("digest").over(order), "after": F.lead("seq").over(order)})
    same, again = F.col("digest") == F.col("before"), F.col("before").isNotNull()
    state = F.when(~came, "stored").when(~again, "added").when(same, "unchanged").otherwise("updated")
    versions = keep(versions.select("month", "id", "seq", "timestamp", state.alias("state"), F.col("after").isNotNull().alias("replaced")))
    counts = [F.count_if(F.col("state") == c).alias(c) for c in ("added", "updated", "unchanged")]
    receipt = versions.groupBy("month").agg(*counts).withColumn("touched", F.col("added") + F.col("updated") > 0)

    marks = versions.where("replaced").groupBy("month", "timestamp", "id", "seq").agg(F.count("*").alias("_lost"))
    dealt = every.unionByName(marks, allowMissingColumns=True).repartitionByRange("month", "timestamp")
    of = Window.partitionBy("month", "timestamp", "id", "seq").orderBy(F.desc_nulls_last("_lost"))
    rows = dealt.withColumns({"_place": F.row_number().over(of), "_gone": F.sum("_lost").over(of)})
    rows = rows.where(F.col("_lost").isNull() & (F.col("_place") > F.coalesce(F.col("_gone") + 1, F.lit(0))))
    return rows.select("month", *columns), receipt


# A batch of changes goes to the history in three steps: its months are written whole
# to a folder of their own, a ledger row says so, and the folders take their places.
# Before the ledger row nothing has changed; after it, whatever stopped can be finished.
STAGED, REPLACED, LEDGER = "_staged", "_replaced", "_ledger"
RECEIPT = "batch STRING, month STRING, added BIGINT, updated BIGINT, unchanged BIGINT, touched BOOLEAN"


def stage_months(rows: DataFrame, receipt: DataFrame, path: str, batch: str) -> None:
    """Write the touched months of a batch, each sorted by moment and id, beside the history.

    ``rows`` come from ``merge``, dealt by month and moment.
    """
    touched = [r[0] for r in receipt.where("touched").select("month").collect()]  # few strings
    kept = rows.where(F.col("month").isin(touched)).sortWithinPartitions("month", "timestamp", "id")
    with swept(rows.sparkSession):
        kept.write.mode("overwrite").partitionBy("month").json(f"{path}/{STAGED}/{batch}")


def enter_ledger(receipt: DataFrame, path: str, batch: str) -> None:
    """The receipt of a batch, in one file that is there or not: from here on the batch counts."""
    receipt.select(F.lit(batch).alias("batch"), "month", "added", "updated", "unchanged", "touched").coalesce(1).write.mode("overwrite").json(f"{path}/{LEDGER}/{batch}")


def in_ledger(spark: SparkSession, path: str, batch: str) -> bool:
    return files.written(spark, f"{path}/{LEDGER}/{batch}")


def settle(spark: SparkSession, path: str) -> None:
    """Finish what the ledger says and drop what it does not know.

    Staged months take the place of the stored ones, which are put aside first and
    removed when all have moved.  It can stop anywhere and be called again.  One
    writer at a time may work on a history.
    """
    for batch in files.children(spark, f"{path}/{STAGED}"):
        staged, aside = f"{path}/{STAGED}/{batch}", f"{path}/{REPLACED}/{batch}"
        if in_ledger(spark, path, batch):
            for month in files.children(spark, staged):
                if month.startswith("month="):
                    if files.exists(spark, f"{path}/{month}"):
                        files.move(spark, f"{path}/{month}", f"{aside}/{month}")
                    files.move(spark, f"{staged}/{month}", f"{path}/{month}")
        files.remove(spark, staged)
    files.remove(spark, f"{path}/{REPLACED}")


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """What each batch did to each month, from the ledger."""
    batches = [f"{path}/{LEDGER}/{b}" for b in files.children(spark, f"{path}/{LEDGER}")]
    return spark.read.schema(RECEIPT).json(batches) if batches else spark.createDataFrame([], RECEIPT)


def write_months(rows: DataFrame, receipt: DataFrame, path: str, batch: str | None = None) -> None:
    """Put a merged batch into the history; a stop at any point loses neither old nor new months."""
    spark, batch = rows.sparkSession, batch or uuid.uuid4().hex
    settle(spark, path)
    stage_months(rows, receipt, path, batch)
    enter_ledger(receipt, path, batch)
    settle(spark, path)


def rolling_feed(messages: DataFrame, now: str, hours: float) -> DataFrame:
    """Messages of the last ``hours`` before ``now``."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(hours * 3600))
    return messages.where(F.try_to_timestamp("timestamp") >= since)


def feed_summary(feed: DataFrame) -> DataFrame:
    return feed.groupBy("server_id").agg(F.count("*").alias("message_count"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def read_feed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A feed or snapshot document as (messages, servers), each with ``generated``."""
    feed = spark.read.schema(schemas.FEED).option("multiLine", True).json(path)
    return feed.select("generated", F.inline_outer("messages")), feed.select("generated", "channels_skipped_no_access", F.inline_outer("servers"))


def write_feed(messages: DataFrame, servers: DataFrame, path: str, generated: str, window_hours: float, skipped: int = 0) -> None:
    """A feed as a folder: ``messages`` in the order of their moments, and one ``feed`` row about them.

    One document with all messages would pass through one task; a folder of
    range-sorted JSON lines has the same rows in the same order.  The ``feed``
    row comes last, so a folder with it is whole.
    """
    ordered = messages.repartitionByRange("timestamp", "id").sortWithinPartitions("timestamp", "id")
    ordered.write.mode("overwrite").json(f"{path}/messages")
    listed = servers.agg(F.collect_list(F.struct(*servers.columns)).alias("servers"))
    count = messages.agg(F.count("*").alias("message_count"))
    row = count.crossJoin(listed).select(  # one row each
        F.lit(generated).alias("generated"), F.lit(float(window_hours)).alias("window_hours"), F.lit(False).alias("all_history"),
        "message_count", F.lit(skipped).cast("long").alias("channels_skipped_no_access"), "servers",
    )
    row.write.mode("overwrite").json(f"{path}/feed")


def write_snapshot(messages: DataFrame, servers: DataFrame, root: str, generated: str, window_hours: float, skipped: int = 0) -> str:
    """A feed kept under the date it was generated on (first ten characters)."""
    path = f"{root}/daily/{generated[:10]}"
    write_feed(messages, servers, path, generated, window_hours, skipped)
    return path


def read_feed_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What ``write_feed`` wrote, as ``read_feed`` returns it; a folder with another number of ``feed`` rows than one fails."""
    about = spark.read.schema(schemas.FEED).json(f"{path}/feed")
    rows = spark.read.schema(schemas.MESSAGE).json(f"{path}/messages")
    one = F.when(F.count("*") == 1, F.max("generated")).otherwise(F.raise_error(F.lit("a feed has one row about it")))
    when = about.agg(one.alias("generated"))
    return when.crossJoin(rows), about.select("generated", "channels_skipped_no_access", F.inline_outer("servers"))  # one row about all


def read_snapshots(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """All dated snapshots as (messages, servers), each with ``snapshot``, its date.

    Fields that a snapshot of an earlier day did not have yet are null; messages
    without a server id get the one their own snapshot lists under the name.
    """
    date = F.regexp_extract(F.input_file_name(), r"/daily/([^/]+)/(?:feed|messages)/[^/]*$", 1).alias("snapshot")
    rows = spark.read.schema(schemas.MESSAGE).json(f"{root}/daily/*/messages").select(date, "*")
    about = spark.read.schema(schemas.FEED).json(f"{root}/daily/*/feed").select(date, "*")
    servers = about.select("snapshot", "generated", "channels_skipped_no_access", F.inline_outer("servers"))
    return attributed(rows, servers), servers


def attributed(messages: DataFrame, servers: DataFrame, platform: str = "discord") -> DataFrame:
    """Messages with the server id of their name, where they have none and one server of the snapshot has that name."""
    known = servers.where("id is not null").groupBy("snapshot", F.col("name").alias("server")).agg(F.count("*").alias("_n"), F.max("id").alias("_id")).where("_n = 1")
    named = F.when(F.contains("_id", F.lit(":")), F.col("_id")).otherwise(F.concat(F.lit(f"{platform}:"), "_id"))
    rows = messages.join(known, ["snapshot", "server"], "left").withColumn("server_id", F.coalesce("server_id", named))
    return rows.select(*messages.columns)


def words_of(spark: SparkSession, path: str) -> DataFrame:
    """(term): the words of a text file, lowered, once each; a report takes them as ``scaffolding``."""
    return spark.read.text(path).select(F.explode(F.split(F.lower("value"), r"\s+")).alias("term")).where("term <> ''").distinct()


def word_list(spark: SparkSession, path: str, most: int = 5000) -> tuple[str, ...]:
    """The same words for a setting, which holds few."""
    found = [r.term for r in words_of(spark, path).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{path} holds more than {most} words")
    return tuple(sorted(found))


def media_manifest(messages: DataFrame, most_mb: float = 50) -> DataFrame:
    """Local name, kind and whether the size fits, for each attachment with a link."""
    rows = messages.select("id", F.inline("attachments").alias("name", "url", "bytes", "file")).where("url is not null and url <> ''")
    parts = F.split(F.regexp_replace(url_path(F.col("url")), "/+$", ""), "/")
    several = F.size(parts) >= 2
    own = F.when(several, F.element_at(parts, -2)).otherwise("x")
    name = F.right(F.regexp_replace(F.coalesce(F.try_url_decode(F.element_at(parts, -1)), F.element_at(parts, -1)), r"(?U)[^\w.\-]", "_"), F.lit(80))
    kind = F.when(F.lower("local").rlike(r"\.(png|jpe?g|gif|webp)$"), "image").when(F.lower("local").rlike(r"\.(mp4|webm|mov)$"), "video").otherwise("file")
    return rows.withColumn("local", F.concat(own, F.lit("-"), name)).select(
        "id", "url", "local", kind.alias("kind"), (F.coalesce("bytes", F.lit(0)) <= most_mb * 1e6).alias("fits")
    )


def threads_in_window(threads: DataFrame, cutoff: str) -> DataFrame:
    """Archived threads that may hold messages after ``cutoff``; unreadable stamps stay."""
    at = F.try_to_timestamp("archive_timestamp")
    return threads.where(at.isNull() | (at >= F.lit(cutoff).cast("timestamp")))


def read_targets(channels: DataFrame, active: DataFrame, archived: DataFrame) -> DataFrame:
    """Places to read, once each: message channels, then active, then archived threads.

    channels: server_id, id, type, name; threads: server_id, id, type, parent_id, name.
    """
    names = channels.select("server_id", F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    plain = channels.where(F.col("type").isin(0, 2, 5)).select("server_id", "id", F.col("id").alias("channel_id"), F.col("name").alias("channel"), F.lit(None).cast("string").alias("thread"), F.lit(0).alias("rank"))
    thread = lambda df, rank: df.where(F.col("type").isin(10, 11, 12)).join(names, ["server_id", "parent_id"], "left").select(
        "server_id", "id", F.coalesce("parent_id", "id").alias("channel_id"), F.coalesce("parent", F.lit("?")).alias("channel"), F.col("name").alias("thread"), F.lit(rank).alias("rank")
    )
    every = plain.unionByName(thread(active, 1)).unionByName(thread(archived, 2))
    first = Window.partitionBy("server_id", "id").orderBy("rank", "channel", "thread")
    return every.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "rank")


def reference_counts(spark: SparkSession, path: str, digest: str | None = None, least_rows: int = 0) -> DataFrame:
    """(term, cnt) of a tab-separated file; odd lines are skipped, the last repeat wins.

    Fails if the file's SHA-256 differs from ``digest`` or it has too few terms.
    """
    if digest is not None:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()
        if found is None or found[0] != digest:
            raise RuntimeError(f"reference frequencies failed the integrity check: {path}")
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(parts.alias("p"), F.monotonically_increasing_id().alias("line")).where(F.size("p") == 2)
    counted = rows.select(F.col("p")[0].alias("term"), F.expr("try_cast(p[1] AS BIGINT)").alias("cnt"), "line").where("cnt is not null")
    out = counted.groupBy("term").agg(F.max_by("cnt", "line").alias("cnt"))
    if least_rows and out.limit(least_rows).count() < least_rows:
        raise RuntimeError("reference frequencies are incomplete")
    return out
