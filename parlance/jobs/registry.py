"""Registered queries over the tables of a folder, and the SQL they are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance import schemas
from parlance.config import DEFAULT
from parlance.functions import text
from parlance.functions.plans import keep, shared_folder
from parlance.jobs import fact_store, sink
from parlance.jobs.oracle import CHAIN, MOVE, TALK, fold, log2
from parlance.jobs.oracle_graph import GRAPH
from parlance.jobs.report import Report
from parlance.operators import community, lexicon, messages, movement, people, topics, units
from parlance.sources import corpus, tables
from parlance.streaming.ingest import ingest, stored_months

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Speakers taken out by the subtraction lenses.
SILENT = ("u1", "u2", "u3")


def query(sql: str | None = None, chain: bool | str = True):
    """Register a query and its SQL, which follows ``chain``: the common expressions, others, or none."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (chain if isinstance(chain, str) else CHAIN if chain else "") + sql
        return f

    return register


def report(spark: SparkSession, d: str) -> Report:
    return Report(tables.messages(spark, d), *tables.reference(spark, d))


# ---- collection and history ------------------------------------------------


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
  '(^|[^A-Za-z0-9_-])sk-[A-Za-z0-9_-]{20,}', '\1[credential redacted]', 'g'),
  '(^|[^A-Za-z0-9_])gh[oprsu]_[A-Za-z0-9]{20,}', '\1[credential redacted]', 'g'),
  '(^|[^A-Za-z0-9_-])xox[baprs]-[A-Za-z0-9-]{10,}', '\1[credential redacted]', 'g'),
  '(^|[^A-Za-z0-9_-])AIza[0-9A-Za-z_-]{30,}', '\1[credential redacted]', 'g'),
  '(^|[^A-Za-z0-9_-])[MN][A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{20,}', '\1[credential redacted]', 'g')) AS message_sha256
FROM (SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' sk-' || repeat('a', 24) WHEN 1 THEN ' ghp_' || repeat('Z9', 12) || ' end' ELSE ' xoxb-' || repeat('1-', 8) END AS t FROM documents)""", chain=False)
def redact_credentials(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    secret = F.when(k == 0, F.concat(F.lit(" sk-"), F.repeat(F.lit("a"), 24))).when(k == 1, F.concat(F.lit(" ghp_"), F.repeat(F.lit("Z9"), 12), F.lit(" end"))).otherwise(F.concat(F.lit(" xoxb-"), F.repeat(F.lit("1-"), 8)))
    docs = tables.table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(text.redact(F.concat(F.coalesce("text", F.lit("")), secret)), 256).alias("message_sha256"))


@query("""SELECT 'discord:' || conv_id || '-' || turn AS id, 'discord:' || conv_id AS server_id, 'discord:' || role AS user_id,
  CASE WHEN role = 'assistant' THEN 'Helper' ELSE role END AS "user", role = 'system' AS is_bot,
  CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE '7' END AS type,
  sha256('to @Nick ' || conv_id || ', @Second Person and <@999> ' || coalesce(text, '')) AS message_sha256,
  CASE WHEN turn > 0 THEN 'discord:' || conv_id || '-' || (turn - 1) END AS reply_to, CASE WHEN turn > 2 THEN 1 ELSE 0 END AS reactions FROM conversations""", chain=False)
def normalize_messages(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("conv_id").cast("string")
    member = lambda i, nick, name: F.struct(F.lit(i).alias("id"), F.lit("x").alias("username"), name.alias("global_name"), F.struct(nick.alias("nick")).alias("member"))
    none = F.lit(None).cast("string")
    raw = tables.table(spark, d, "conversations").select(
        F.concat(c, F.lit("-"), "turn").alias("id"), c.alias("guild_id"), F.lit("g").alias("guild_name"), F.lit("1").alias("channel_id"), F.lit("room").alias("channel_name"),
        F.lit("1").alias("target_id"), none.alias("thread_id"), none.alias("thread_name"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
        F.element_at(F.array(F.lit(0), F.lit(19), F.lit(7)), (F.col("turn") % 3 + 1).cast("int")).alias("type"),
        F.concat(F.lit("to <@42>, <@!84> and <@999> "), F.coalesce("text", F.lit(""))).alias("content"),
        F.struct(F.col("role").alias("id"), F.col("role").alias("username"), F.when(F.col("role") == "assistant", "Helper").alias("global_name"), (F.col("role") == "system").alias("bot")).alias("author"),
        F.array(member("42", F.concat(F.lit("Nick "), c), none), member("84", none, F.lit("Second Person"))).alias("mentions"),
        F.struct(F.when(F.col("turn") > 0, F.concat(c, F.lit("-"), F.col("turn") - 1)).alias("message_id")).alias("message_reference"),
        F.array().cast("array<struct<filename:string,url:string,size:bigint>>").alias("attachments"),
        F.when(F.col("turn") > 2, F.array(F.struct(F.struct(F.lit("x").alias("name")).alias("emoji"), F.lit(1).cast("long").alias("count")))).alias("reactions"),
    )
    rows = corpus.normalize(raw)
    return rows.select("id", "server_id", "user_id", "user", "is_bot", "type", F.sha2("message", 256).alias("message_sha256"), "reply_to", F.coalesce(F.size("reactions"), F.lit(0)).alias("reactions"))


@query("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS messages, min(id) AS first_id FROM msg GROUP BY 1")
def month_partitions(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.messages(spark, d).withColumn("month", corpus.month_of(F.col("timestamp")))
    return rows.groupBy("month").agg(F.count("*").alias("messages"), F.min("id").alias("first_id"))


@query("""SELECT strftime(ts, '%Y-%m') AS month, count(*) FILTER (WHERE doc_id % 3 = 0 AND doc_id % 2 = 0) AS added,
  count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 4 = 0) AS updated, count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 4 = 2) + count(*) FILTER (WHERE doc_id % 10 = 0) AS unchanged,
  count(*) FILTER (WHERE doc_id % 3 = 0 AND doc_id % 2 = 0) + count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 4 = 0) > 0 AS touched,
  count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0) AS with_file
FROM msg GROUP BY 1 HAVING count(*) FILTER (WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0) > 0""")
def corpus_merge(spark: SparkSession, d: str) -> DataFrame:
    """Receipt of an upsert: two thirds are stored, every second comes again, half of these changed, every fifth of them twice.

    Four of five stored messages have an attachment with a local file, which only the
    stored version knows: one that comes again is unchanged if the file is carried on.
    """
    n = F.substring_index("id", ":", -1).cast("long")
    some = F.array().cast("array<struct<name:string,url:string,bytes:bigint,file:string>>")

    def with_files(df: DataFrame, file: Column) -> DataFrame:
        link = F.concat(F.lit("https://cdn.example.org/a/"), n, F.lit("/f.png?ex=1"))
        one = F.array(F.struct(F.lit("f.png").alias("name"), link.alias("url"), F.lit(1).cast("long").alias("bytes"), file.cast("string").alias("file")))
        return df.withColumn("attachments", F.when(n % 5 == 0, some).otherwise(one))

    rows = tables.messages(spark, d)
    stored = with_files(rows.where(n % 3 != 0), F.concat(F.lit("media/"), n)).withColumn("month", corpus.month_of(F.col("timestamp")))
    incoming = with_files(rows.where(n % 2 == 0), F.lit(None)).withColumn("message", F.when(n % 4 == 0, F.concat(F.coalesce("message", F.lit("")), F.lit(" edited"))).otherwise(F.col("message")))
    incoming = incoming.withColumn("seq", F.explode(F.when(n % 10 == 0, F.array(2 * n, 2 * n + 1)).otherwise(F.array(2 * n))))
    merged, receipt = corpus.merge(stored, incoming)
    held = merged.groupBy("month").agg(F.count_if(F.exists("attachments", lambda a: a["file"].isNotNull())).alias("with_file"))
    return receipt.join(held, "month")


@query("""SELECT batch::INT AS batch, month, added, updated, unchanged FROM (
  SELECT 0 AS batch, strftime(ts, '%Y-%m') AS month, count(*) AS added, 0::BIGINT AS updated, 0::BIGINT AS unchanged FROM msg WHERE doc_id % 3 <> 0 GROUP BY 2
  UNION ALL SELECT 1, strftime(ts, '%Y-%m'), count(*) FILTER (WHERE doc_id % 3 = 0 AND doc_id % 2 = 0), count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 4 = 0), count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 4 = 2)
  FROM msg GROUP BY 2 HAVING count(*) FILTER (WHERE doc_id % 2 = 0) > 0)""")
def ingest_receipts(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of a history after two batches: two thirds of all, then every second, half of these changed."""
    n, rows = F.substring_index("id", ":", -1).cast("long"), tables.messages(spark, d)
    place = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    changed = F.when(n % 4 == 0, F.concat(F.coalesce("message", F.lit("")), F.lit(" edited"))).otherwise(F.col("message"))
    for batch in (rows.where(n % 3 != 0), rows.where(n % 2 == 0).withColumn("message", changed)):
        batch.write.mode("append").json(f"{place}/incoming")
        ingest(spark, f"{place}/incoming", f"{place}/history", f"{place}/checkpoint").awaitTermination()
    told = corpus.receipts(spark, f"{place}/history")
    return told.select(F.substring_index("batch", "-", -1).cast("int").alias("batch"), "month", "added", "updated", "unchanged")


@query("""SELECT id, min(month) AS month, count(*) AS copies FROM (
  SELECT id, strftime(ts, '%Y-%m') AS month FROM msg UNION ALL SELECT id, strftime(ts + INTERVAL 40 DAY, '%Y-%m') FROM msg WHERE doc_id % 5 = 0) GROUP BY 1""")
def history_read(spark: SparkSession, d: str) -> DataFrame:
    """Ids that stand in two months are read once, from the earlier one."""
    rows = tables.messages(spark, d)
    later = F.date_format(F.timestamp_add("DAY", F.lit(40), F.to_timestamp("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    again = rows.where(F.substring_index("id", ":", -1).cast("long") % 5 == 0).withColumn("timestamp", later)
    stored = rows.unionByName(again).withColumn("month", corpus.month_of(F.col("timestamp")))
    copies = stored.groupBy("id").agg(F.count("*").alias("copies"))
    return corpus.unique_history(stored).select("id", "month").join(copies, "id")


@query("""SELECT server_id, count(*) AS message_count, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last
FROM msg WHERE ts >= TIMESTAMP '2024-07-29' - INTERVAL 720 HOUR GROUP BY 1""")
def rolling_feed(spark: SparkSession, d: str) -> DataFrame:
    return corpus.feed_summary(corpus.rolling_feed(tables.messages(spark, d), "2024-07-29 00:00:00", 720))


def feed_servers(spark: SparkSession, d: str) -> DataFrame:
    """Languages as servers of a feed, sources as the places that were read."""
    docs = tables.table(spark, d, "documents").where("lang is not null")
    coverage = F.struct(
        F.countDistinct("source").alias("targets"), F.count_if(F.col("doc_id") % 5 == 0).alias("public_archived_threads"),
        F.count_if(F.col("doc_id") % 50 == 0).alias("private_archived_threads"), F.lit("joined").alias("private_archived_scope"),
    )
    return docs.groupBy(F.concat(F.lit("Server "), "lang").alias("name"), F.col("lang").alias("id")).agg(
        F.lit(None).cast("string").alias("icon"), F.count("*").alias("member_count"), F.array(F.first("lang")).alias("member_aliases"), coverage.alias("coverage")
    )


@query("""SELECT server_id, count(*) AS message_count, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last, '2024-07-29T00:00:00Z' AS generated,
  sum(('0x' || md5(coalesce(message, ''))[1:8])::BIGINT)::BIGINT AS texts_sum
FROM msg WHERE ts >= TIMESTAMP '2024-07-29' - INTERVAL 240 HOUR GROUP BY 1""")
def feed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A rolling feed written with its wrapper and read back, texts and all."""
    place = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    corpus.write_feed(corpus.rolling_feed(tables.messages(spark, d), "2024-07-29 00:00:00", 240), feed_servers(spark, d), place, "2024-07-29T00:00:00Z", 240)
    rows, _ = corpus.read_feed_folder(spark, place)
    digest = F.conv(F.left(F.md5(F.coalesce("message", F.lit(""))), F.lit(8)), 16, 10).cast("long")
    return rows.groupBy("server_id").agg(F.count("*").alias("message_count"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.max("generated").alias("generated"), F.sum(digest).alias("texts_sum"))


@query("""SELECT '2024-05-01' AS snapshot, 'discord:' || server_id AS server_id, count(*) AS message_count, min(id) AS first_id, max(member_count) AS member_count FROM msg LEFT JOIN (SELECT lang, count(*) AS member_count FROM documents GROUP BY 1) n ON n.lang = server_id
  WHERE ts >= TIMESTAMP '2024-05-01' - INTERVAL 240 HOUR AND ts < TIMESTAMP '2024-05-01' GROUP BY 2
UNION ALL SELECT '2024-07-29', server_id, count(*), min(id), max(member_count) FROM msg LEFT JOIN (SELECT lang, count(*) AS member_count FROM documents GROUP BY 1) n ON n.lang = server_id WHERE ts >= TIMESTAMP '2024-07-29' - INTERVAL 240 HOUR GROUP BY 2""")
def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Two dated snapshots read together; the older one's messages have no server id yet."""
    root, rows = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}", tables.messages(spark, d)
    old = corpus.rolling_feed(rows, "2024-05-01 00:00:00", 240).where(F.to_timestamp("timestamp") < F.lit("2024-05-01").cast("timestamp"))
    for part, day in ((old.drop("server_id", "type"), "2024-05-01"), (corpus.rolling_feed(rows, "2024-07-29 00:00:00", 240), "2024-07-29")):
        corpus.write_snapshot(part, feed_servers(spark, d), root, f"{day}T00:00:00Z", 240)
    found, servers = corpus.read_snapshots(spark, root)
    members = servers.select("snapshot", F.col("id").alias("bare"), "member_count")
    counted = found.groupBy("snapshot", "server_id").agg(F.count("*").alias("message_count"), F.min("id").alias("first_id"))
    joined = counted.withColumn("bare", F.regexp_replace("server_id", "^discord:", "")).join(members, ["snapshot", "bare"], "left")
    return joined.select("snapshot", "server_id", "message_count", "first_id", "member_count")


@query("""SELECT m.server_id, stored, eligible, '2024-07-29T00:00:00Z' AS collector_generated, 3::BIGINT AS channels_skipped_no_access, member_count, targets, public_archived_threads, private_archived_threads, 'joined' AS private_archived_scope
FROM (SELECT server_id, count(*) AS stored, count(*) FILTER (WHERE NOT is_bot) AS eligible FROM msg WHERE server_id IS NOT NULL GROUP BY 1) m
JOIN (SELECT lang, count(*) AS member_count, count(DISTINCT source) AS targets, count(*) FILTER (WHERE doc_id % 5 = 0) AS public_archived_threads, count(*) FILTER (WHERE doc_id % 50 = 0) AS private_archived_threads FROM documents GROUP BY 1) s ON s.lang = m.server_id""")
def collection_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Stored and eligible records beside what the last of two collections said."""
    said = feed_servers(spark, d).withColumns({"generated": F.lit("2024-07-29T00:00:00Z"), "channels_skipped_no_access": F.lit(3).cast("long")})
    older = said.withColumns({"generated": F.lit("2024-07-28T00:00:00Z"), "channels_skipped_no_access": F.lit(9).cast("long"), "member_count": F.lit(1).cast("long")})
    return messages.collection_coverage(tables.messages(spark, d), said.unionByName(older))


@query("""SELECT reason, count(*) AS records FROM (
  SELECT CASE WHEN server_id IS NULL OR doc_id % 31 = 0 THEN 'no community' WHEN is_bot THEN 'bot' WHEN doc_id % 29 = 0 THEN 'no readable moment' WHEN doc_id % 13 = 0 THEN 'not a message or reply' END AS reason FROM msg) WHERE reason IS NOT NULL GROUP BY 1""")
def skipped_records(spark: SparkSession, d: str) -> DataFrame:
    """Records no report can use, by the first reason that holds."""
    n = F.substring_index("id", ":", -1).cast("long")
    rows = tables.messages(spark, d).withColumns({
        "server_id": F.when(n % 31 == 0, F.when(n % 2 == 0, "")).otherwise(F.col("server_id")),
        "timestamp": F.when(n % 29 == 0, "some day").otherwise(F.col("timestamp")),
        "type": F.when(n % 13 == 0, "7").otherwise(F.col("type")),
    })
    return messages.skipped_records(rows)


@query(r"""SELECT id, url, local, CASE WHEN regexp_matches(lower(local), '\.(png|jpe?g|gif|webp)$') THEN 'image' WHEN regexp_matches(lower(local), '\.(mp4|webm|mov)$') THEN 'video' ELSE 'file' END AS kind, bytes <= 50 * 1e6 AS fits
FROM (SELECT id, url, bytes, part[-2] || '-' || right(regexp_replace(part[-1], '[^A-Za-z0-9_.\-]', '_', 'g'), 80) AS local FROM (
  SELECT page_id::VARCHAR AS id, 'https://cdn.example.org/attachments/' || page_id || '/my file-' || (page_id % 7) || list_value('.png', '.MP4', '.txt')[page_id % 3 + 1] AS url, page_id * 100000 AS bytes,
    string_split('/attachments/' || page_id || '/my file-' || (page_id % 7) || list_value('.png', '.MP4', '.txt')[page_id % 3 + 1], '/') AS part FROM pages))""", chain=False)
def media_manifest(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    end = F.element_at(F.array(F.lit(".png"), F.lit(".MP4"), F.lit(".txt")), (p % 3 + 1).cast("int"))
    link = F.concat(F.lit("https://cdn.example.org/attachments/"), p, F.lit("/my%20file-"), p % 7, end, F.lit("?ex=1"))
    none = F.lit(None).cast("string")
    rows = tables.table(spark, d, "pages").select(p.cast("string").alias("id"), F.array(F.struct(none.alias("name"), link.alias("url"), (p * 100000).alias("bytes"), none.alias("file"))).alias("attachments"))
    found = corpus.media_manifest(rows)
    return found.withColumn("url", F.replace(F.regexp_replace("url", r"\?.*$", ""), F.lit("%20"), F.lit(" ")))


@query("""SELECT event_id, event_type FROM events WHERE event_id % 11 = 0 OR ts >= TIMESTAMP '2024-01-15 00:00:00'""", chain=False)
def threads_in_window(spark: SparkSession, d: str) -> DataFrame:
    """Events as archived threads; one stamp in eleven cannot be read and stays."""
    stamp = F.when(F.col("event_id") % 11 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    threads = tables.table(spark, d, "events").select("event_id", "event_type", stamp.alias("archive_timestamp"))
    return corpus.threads_in_window(threads, "2024-01-15 00:00:00").select("event_id", "event_type")


@query("""SELECT lang AS server_id, doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 < 2 THEN doc_id::VARCHAR ELSE (doc_id - doc_id % 4)::VARCHAR END AS channel_id,
  CASE WHEN doc_id % 4 < 2 THEN source WHEN p.doc IS NULL THEN '?' ELSE p.src END AS channel, CASE WHEN doc_id % 4 < 2 THEN NULL ELSE 't-' || source END AS thread
FROM documents d LEFT JOIN (SELECT doc_id AS doc, lang AS l, source AS src FROM documents WHERE doc_id % 4 < 2) p ON p.doc = d.doc_id - d.doc_id % 4 AND p.l = d.lang AND d.doc_id % 4 >= 2""", chain=False)
def read_targets(spark: SparkSession, d: str) -> DataFrame:
    """Documents as channels (two of four), active and archived threads; archived ones listed twice."""
    docs, k = tables.table(spark, d, "documents"), F.col("doc_id") % 4
    channels = docs.where(k < 2).select(F.col("lang").alias("server_id"), F.col("doc_id").cast("string").alias("id"), F.lit(0).alias("type"), F.col("source").alias("name"))
    thread = lambda x: docs.where(x).select(F.col("lang").alias("server_id"), F.col("doc_id").cast("string").alias("id"), F.lit(11).alias("type"), (F.col("doc_id") - k).cast("string").alias("parent_id"), F.concat(F.lit("t-"), "source").alias("name"))
    return corpus.read_targets(channels, thread(k == 2), thread(k >= 2))


@query("SELECT event_id, (ms - 1420070400000) * 4194304 AS snowflake, ms AS back_ms FROM (SELECT event_id, trunc(epoch_us(ts) / 1e6 * 1000)::BIGINT AS ms FROM events)", chain=False)
def snowflakes(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = tables.table(spark, d, "events").select("event_id", text.snowflake(seconds).alias("snowflake"))
    return rows.withColumn("back_ms", F.round(text.snowflake_seconds(F.col("snowflake")) * 1000).cast("long"))


@query("""SELECT server_id, id, sha256(coalesce(message, '')) AS message_sha256 FROM msg WHERE contains(lower(message), 'stupid') OR contains(lower("user"), 'stupid')""")
def feed_search(spark: SparkSession, d: str) -> DataFrame:
    return messages.search(tables.messages(spark, d), "Stupid").select("server_id", "id", F.sha2(F.coalesce("message", F.lit("")), 256).alias("message_sha256"))


@query("""SELECT server, channel, count(*) AS messages, grouping_id(server, channel)::BIGINT AS level FROM msg GROUP BY ROLLUP (server, channel)""")
def side_bar(spark: SparkSession, d: str) -> DataFrame:
    return messages.side_bar(tables.messages(spark, d))


@query("SELECT server_id, count(*) AS stored, count(*) FILTER (WHERE NOT is_bot) AS eligible FROM msg GROUP BY 1")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return messages.coverage(tables.messages(spark, d))


@query("""SELECT server_id, stored, eligible, name, row_number() OVER (ORDER BY (server_id = 'fr') DESC, stored DESC, server_id) AS place FROM (
  SELECT server_id, count(*) AS stored, count(*) FILTER (WHERE NOT is_bot) AS eligible, arg_max(server, (ts, id)) FILTER (WHERE NOT is_bot) AS name FROM msg WHERE server_id IS NOT NULL GROUP BY 1) WHERE eligible > 0""")
def server_index(spark: SparkSession, d: str) -> DataFrame:
    return messages.server_index(tables.messages(spark, d), "fr")


@query("""SELECT DISTINCT server_id, alias FROM (SELECT server_id, alias FROM alias UNION ALL SELECT lang, unnest(regexp_extract_all(lower('Defender ' || source), '[a-z][a-z''\\-]{2,}')) FROM documents)""")
def member_aliases(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    roster = tables.table(spark, d, "documents").select(F.col("lang").alias("server_id"), F.concat(F.lit("Defender "), "source").alias("nick"), F.struct(none.alias("id"), none.alias("username"), none.alias("global_name")).alias("user"))
    return messages.member_aliases(tables.messages(spark, d), roster)


# ---- tokens, inventories, activity -----------------------------------------


@query("""SELECT id, n_tokens::INT AS n_tokens, coalesce(b, 0)::INT AS n_breaks, sha256(coalesce(array_to_string(tk, ' '), '')) AS tokens_sha256
FROM tok LEFT JOIN (SELECT id, count(*) AS b FROM t_next WHERE brk AND w2 IS NOT NULL GROUP BY 1) USING (id)""")
def token_streams(spark: SparkSession, d: str) -> DataFrame:
    rows = messages.tokenized(tables.messages(spark, d))
    return rows.select("id", F.size("tokens").alias("n_tokens"), F.size(F.filter("breaks", lambda b: b)).alias("n_breaks"), F.sha2(F.array_join("tokens", " "), 256).alias("tokens_sha256"))


@query("SELECT id, size::INT AS size, count(*) AS n, min(pos)::INT AS first_pos, min(term) AS first_term, max(term) AS last_term FROM t_gram WHERE size > 1 GROUP BY 1, 2")
def candidate_ngrams(spark: SparkSession, d: str) -> DataFrame:
    rows = messages.tokenized(tables.messages(spark, d))
    places = rows.select("id", text.places(F.col("tokens"), F.col("breaks")))
    one = places.select("id", "pos", F.inline(F.array(*[F.struct(F.lit(n).alias("size"), text.gram(n).alias("term")) for n in (2, 3)]))).where("term is not null")
    return one.groupBy("id", "size").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))


TOTALS = "server_id, messages, tokens, voices, channels, first_ts, last_ts"


@query(f"SELECT {TOTALS} FROM tot")
def window_totals(spark: SparkSession, d: str) -> DataFrame:
    return messages.totals(messages.tokenized(tables.messages(spark, d)))


@query(f"SELECT {TOTALS} FROM alltot")
def history_totals(spark: SparkSession, d: str) -> DataFrame:
    return messages.totals(messages.tokenized(tables.messages(spark, d)), False)


@query("SELECT server_id, week, sum(n_tokens)::BIGINT AS tokens FROM tok GROUP BY 1, 2")
def weekly_tokens(spark: SparkSession, d: str) -> DataFrame:
    return messages.tokenized(tables.messages(spark, d)).groupBy("server_id", "week").agg(F.sum(F.size("tokens")).alias("tokens"))


def facts(spark: SparkSession, d: str, *sizes: int, current: bool = True) -> DataFrame:
    tokens = messages.tokenized(tables.messages(spark, d))
    return messages.term_facts(tokens.where("is_current") if current else tokens, sizes or (1, 2, 3))


INVENTORY = "server_id, size::INT AS size, term, uses, voices, active_days, first_ts"


@query(f"SELECT {INVENTORY} FROM hist WHERE size = 1")
def history_words(spark: SparkSession, d: str) -> DataFrame:
    return messages.inventory(facts(spark, d, 1, current=False), False)


@query(f"SELECT {INVENTORY} FROM hist WHERE size > 1 AND uses >= {DEFAULT.min_phrase_uses}")
def history_phrases(spark: SparkSession, d: str) -> DataFrame:
    return messages.phrase_inventory(keep(messages.tokenized(tables.messages(spark, d))), DEFAULT.min_phrase_uses)


@query(f"SELECT {INVENTORY} FROM inv")
def window_inventory(spark: SparkSession, d: str) -> DataFrame:
    return messages.inventory(facts(spark, d), True)


def merged_in_three(spark: SparkSession, d: str) -> tuple[str, str]:
    """(history, facts) after three merges, each with a refresh of the months it touched.

    The first stores two thirds, an early quarter of them with other texts; the second
    puts these right, the third adds the rest: in the end all messages stand as they are.
    """
    place, rows, n = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}", tables.messages(spark, d), F.substring_index("id", ":", -1).cast("long")
    history, store = f"{place}/history", f"{place}/facts"
    wrong = (n % 4 == 0) & (F.col("timestamp") < "2024-03-11")
    first = rows.where(n % 3 != 0).withColumn("message", F.when(wrong, F.concat(F.lit("quantum wrong words "), F.coalesce("message", F.lit("")))).otherwise(F.col("message")))
    shape = spark.createDataFrame([], schemas.MESSAGE)
    for k, batch in enumerate((first, rows.where((n % 3 != 0) & wrong), rows.where(n % 3 == 0))):
        incoming = shape.unionByName(batch, allowMissingColumns=True).withColumn("seq", F.substring_index("id", ":", -1).cast("long"))
        touched = sorted({r[0] for r in incoming.select(corpus.month_of(F.col("timestamp"))).distinct().collect()})
        corpus.write_months(*corpus.merge(stored_months(spark, history, touched), incoming), history, f"b{k}")
        changed = corpus.receipts(spark, history).where(f"batch = 'b{k}' and touched").select("month").collect()
        fact_store.refresh(spark, history, store, [r[0] for r in changed], batch=f"b{k}")
    return history, store


@query(f"SELECT {INVENTORY} FROM hist")
def incremental_history(spark: SparkSession, d: str) -> DataFrame:
    """The inventory of the whole history from facts renewed by month."""
    return fact_store.history_inventory(spark, merged_in_three(spark, d)[1])


@query(f"SELECT {INVENTORY} FROM inv")
def incremental_window(spark: SparkSession, d: str) -> DataFrame:
    """The window's inventory from the same facts."""
    return fact_store.window_inventory(spark, *merged_in_three(spark, d))


@query("SELECT server_id, speaker, size::INT AS size, sum(uses)::BIGINT AS uses, count(DISTINCT term) AS terms FROM fact WHERE is_current GROUP BY 1, 2, 3")
def person_terms(spark: SparkSession, d: str) -> DataFrame:
    return messages.roll_up(facts(spark, d), "speaker", "size", "term").groupBy("server_id", "speaker", "size").agg(F.sum("uses").alias("uses"), F.count("*").alias("terms"))


@query("SELECT server_id, channel, size::INT AS size, sum(uses)::BIGINT AS uses, count(DISTINCT term) AS terms FROM fact WHERE is_current GROUP BY 1, 2, 3")
def channel_terms(spark: SparkSession, d: str) -> DataFrame:
    return messages.roll_up(facts(spark, d), "channel", "size", "term").groupBy("server_id", "channel", "size").agg(F.sum("uses").alias("uses"), F.count("*").alias("terms"))


@query("SELECT server_id, day, messages, tokens, voices FROM act")
def daily_activity(spark: SparkSession, d: str) -> DataFrame:
    return messages.daily_activity(messages.tokenized(tables.messages(spark, d)))


@query("""SELECT s.server_id, (c // 24)::INT AS weekday, (c % 24)::INT AS hour, coalesce(n, 0)::BIGINT AS messages FROM (SELECT DISTINCT server_id FROM tok) s CROSS JOIN (SELECT unnest(range(0, 168)) AS c)
LEFT JOIN (SELECT server_id, (isodow(ts) - 1) * 24 + hour(ts) AS c, count(*) AS n FROM tok WHERE is_current GROUP BY 1, 2) USING (server_id, c)""")
def heat_map(spark: SparkSession, d: str) -> DataFrame:
    return messages.heat_map(messages.tokenized(tables.messages(spark, d)))


@query("SELECT server_id, speaker, name, messages, tokens, active_days, channels, share FROM ppl")
def people_activity(spark: SparkSession, d: str) -> DataFrame:
    return messages.people_activity(messages.tokenized(tables.messages(spark, d)))


@query(r"""SELECT 'all' AS server_id, domain, count(*) AS uses, count(DISTINCT speaker) AS voices, count(DISTINCT day) AS active_days FROM (
  SELECT page_id % 50 AS speaker, page_id % 30 AS day, regexp_replace(regexp_extract(lower(rtrim(url, '.,;:!?)]}')), '^https?://([^/?#:]+)', 1), '^www\.', '') AS domain FROM pages) WHERE domain <> '' GROUP BY domain""", chain=False)
def link_domains(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    rows = tables.table(spark, d, "pages").select(F.lit("all").alias("server_id"), F.lit(True).alias("is_current"), (p % 50).alias("speaker"), (p % 30).alias("day"), F.timestamp_seconds(p).alias("ts"), F.concat(F.lit("see "), F.col("url"), F.lit(". <")).alias("message"))
    return messages.link_domains(rows)


@query("""SELECT server_id, symbol, sum(n)::BIGINT AS uses FROM (
  SELECT 'u' || (user_id % 3) AS server_id, event_type AS symbol, event_id % 5 AS n FROM events
  UNION ALL SELECT 'u' || (user_id % 3), 'wave', 1 FROM events UNION ALL SELECT 'u' || (user_id % 3), chr(128640), 1 FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT 'u' || (user_id % 3), 'media attachment', 1 FROM events WHERE event_id % 7 = 0) GROUP BY 1, 2""", chain=False)
def symbols(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    none = F.lit(None).cast("string")
    media = F.array(F.struct(none.alias("name"), none.alias("url"), F.lit(0).cast("long").alias("bytes"), none.alias("file")))
    rows = tables.table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id") % 3).alias("server_id"),
        F.concat(F.lit("hi <:wave:12> "), F.when(e % 2 == 0, "\U0001f680").otherwise("")).alias("message"),
        F.array(F.struct(F.col("event_type").alias("emoji"), (e % 5).alias("count"))).alias("reactions"),
        F.when(e % 7 == 0, media).otherwise(F.array().cast("array<struct<name:string,url:string,bytes:bigint,file:string>>")).alias("attachments"),
    )
    return messages.symbols(rows)


# ---- scoring ---------------------------------------------------------------

LEXICON = """SELECT server_id, place::INT AS place, term, uses, voices, CASE WHEN rate = 0 THEN 'not_found' ELSE 'measured' END AS reference_status,
  CASE WHEN rate > 0 THEN round(rate * n, 4) END AS reference_expected, CASE WHEN rate > 0 THEN round(rate * 1e6, 4) END AS reference_ppm,
  round(uses / greatest(n, 1) * 1e6, 1) AS local_ppm, CASE WHEN rate > 0 THEN round(lift, 1) END AS lift FROM lex"""


@query(LEXICON)
def lexicon_table(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).lexicon()


QUERIES["lexicon"], ORACLE_SQL["lexicon"] = QUERIES.pop("lexicon_table"), ORACLE_SQL.pop("lexicon_table")


@query("SELECT server_id, size::INT AS size, place::INT AS place, term, uses, voices, active_days, round(association, 3) AS association, round(reference_lift, 1) AS reference_lift FROM phr")
def phrases(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).phrases()


@query("SELECT server_id, term, uses, voices, active_days, association, reference_lift FROM big")
def qualified_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).bigrams().select("server_id", "term", "uses", "voices", "active_days", "association", "reference_lift")


@query("SELECT server_id, term, uses, round(rate * 1e6, 4) AS ppm, round(lift, 4) AS lift, reportable, about FROM voc")
def vocabulary_rates(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).vocabulary().select("server_id", "term", "uses", F.round(F.col("rate") * 1e6, 4).alias("ppm"), F.round("lift", 4).alias("lift"), "reportable", "about")


@query("SELECT server_id, term, kind, sum(uses)::BIGINT AS uses, count(DISTINCT speaker) AS voices, count(DISTINCT day) AS active_days, sum(documents)::BIGINT AS documents FROM ufact GROUP BY 1, 2, 3")
def semantic_units(spark: SparkSession, d: str) -> DataFrame:
    r = report(spark, d)
    found = units.unit_facts(units.unit_rows(r.tokens, r.bigrams()))
    return found.groupBy("server_id", "term", "kind").agg(F.sum("uses").alias("uses"), F.countDistinct("speaker").alias("voices"), F.countDistinct("day").alias("active_days"), F.sum("documents").alias("documents"))


@query("SELECT server_id, speaker, kind, sum(uses)::BIGINT AS uses, count(DISTINCT term) AS units FROM ufact GROUP BY 1, 2, 3")
def person_units(spark: SparkSession, d: str) -> DataFrame:
    r = report(spark, d)
    found = units.unit_facts(units.unit_rows(r.tokens, r.bigrams()))
    return found.groupBy("server_id", "speaker", "kind").agg(F.sum("uses").alias("uses"), F.countDistinct("term").alias("units"))


@query(f"SELECT server_id, term, arg_min(c, k) AS canonical FROM (SELECT server_id, term, unnest({fold('term')}) AS c, unnest([1, 2, 3]) AS k FROM inv WHERE size = 1) JOIN (SELECT server_id, term AS c FROM inv WHERE size = 1) USING (server_id, c) GROUP BY 1, 2")
def plural_fold(spark: SparkSession, d: str) -> DataFrame:
    r = report(spark, d)
    return units.folded(r.observed().select("server_id", "term"), r.observed()).where("canonical <> term")


@query("SELECT server_id, term, kind, uses, voices, documents FROM uinv")
def unit_inventory(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).graph()["inventory"]


@query("SELECT server_id, term, kind, uses, voices, documents, round(lift, 4) AS lift FROM node")
def topic_nodes(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).graph()["nodes"].withColumn("lift", F.round("lift", 4))


@query("SELECT server_id, day, l, r, documents FROM pair")
def pair_documents(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).graph()["pairs"]


EDGES = "server_id, l, r, documents, round(association, 6) AS association, round(weight, 6) AS weight, relation"


@query(f"SELECT {EDGES} FROM edge")
def semantic_edges(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).graph()["edges"].withColumns({"association": F.round("association", 6), "weight": F.round("weight", 6)})


@query(f"SELECT {EDGES} FROM pruned")
def pruned_edges(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).graph()["pruned"].withColumns({"association": F.round("association", 6), "weight": F.round("weight", 6)})


@query("SELECT server_id, topic, label, voices, mentions, place FROM topic", chain=GRAPH)
def topic_families(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).topics()[0]


@query("SELECT server_id, topic, label, term, kind, uses, voices, lift, rank, label_visible FROM member", chain=GRAPH)
def topic_units(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).topics()[1]


def shares(spark: SparkSession, d: str) -> DataFrame:
    r = report(spark, d)
    g = r.graph()
    series = topics.topic_series(r.topics()[1], g["canonical"], messages.daily_activity(r.tokens))
    shared = topics.daily_share(topics.causal(series, ["server_id", "topic"]), "topic", ["server_id"])
    return shared.withColumns({"smooth": F.round("smooth", 6), "share": F.round("share", 6)})


@query("SELECT server_id, topic, day, value, round(smooth, 6) AS smooth, round(share, 6) AS share, day_rank FROM tshare", chain=GRAPH)
def topic_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(spark, d)


@query("SELECT server_id, day, day_rank, topic, round(share, 6) AS share FROM tshare WHERE day_rank <= 5 AND share > 0", chain=GRAPH)
def topics_of_day(spark: SparkSession, d: str) -> DataFrame:
    return shares(spark, d).where("day_rank <= 5 and share > 0").select("server_id", "day", "day_rank", "topic", "share")


@query("""SELECT server_id, day, topic, round(share, 6) AS share FROM (
  SELECT *, row_number() OVER (PARTITION BY server_id, day ORDER BY label_visible DESC, round(share, 9) DESC, topic) AS k FROM (
    SELECT u.*, v.label_visible, CASE WHEN sum(smooth) OVER (PARTITION BY u.server_id, day) > 0 THEN smooth / sum(smooth) OVER (PARTITION BY u.server_id, day) ELSE 0 END AS share
    FROM uday u JOIN (SELECT DISTINCT server_id, kind || '|' || term AS topic, label_visible FROM shown) v ON v.server_id = u.server_id AND v.topic = u.topic) WHERE share > 0) WHERE k = 1""", chain=GRAPH)
def dominant_units(spark: SparkSession, d: str) -> DataFrame:
    """The visible unit with the largest share of each day, or any unit if none is visible."""
    r = report(spark, d)
    g = r.graph()
    members = topics.shown_units(r.topics()[1])
    one = members.withColumn("topic", F.concat_ws("|", "kind", "term"))
    series = topics.daily_share(topics.topic_series(one, g["canonical"], messages.daily_activity(r.tokens)).withColumnRenamed("value", "smooth"), "topic", ["server_id"])
    seen = series.join(one.select("server_id", "topic", "label_visible").distinct(), ["server_id", "topic"]).where("share > 0")
    return lexicon.ranked(seen, F.desc("label_visible"), F.desc(F.round("share", 9)), F.col("topic"), top=1, keys=("server_id", "day")).select("server_id", "day", "topic", F.round("share", 6).alias("share"))


@query("SELECT server_id, l, r, weight, documents, relation FROM vis", chain=GRAPH)
def visible_edges(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).visible_edges()


@query("""SELECT v.server_id, v.l, v.r, a.day, round(coalesce(greatest(e.seen, e.made), 0) / greatest(a.messages, 1) * 1000, 3) AS value
FROM vis v JOIN act a ON a.server_id = v.server_id LEFT JOIN eday e ON e.server_id = v.server_id AND e.l = v.l AND e.r = v.r AND e.day = a.day""", chain=GRAPH)
def visible_edge_series(spark: SparkSession, d: str) -> DataFrame:
    r = report(spark, d)
    return topics.edge_series(r.visible_edges(), r.graph()["days"], messages.daily_activity(r.tokens))


@query("""SELECT server_id, channel, day, round(value, 3) AS value, round(smooth, 6) AS smooth, round(CASE WHEN whole > 0 THEN smooth / whole ELSE 0 END, 6) AS share FROM (
  SELECT *, sum(smooth) OVER (PARTITION BY server_id, day) AS whole FROM (
    SELECT server_id, channel, day, value, (value * 0.58 + coalesce(lag(value, 1) OVER w, 0) * 0.29 + coalesce(lag(value, 2) OVER w, 0) * 0.13)
      / CASE row_number() OVER w WHEN 1 THEN 0.58 WHEN 2 THEN 0.58 + 0.29 ELSE 0.58 + 0.29 + 0.13 END AS smooth
    FROM (SELECT c.server_id, c.channel, a.day, coalesce(t.n, 0) / greatest(a.tokens, 1) * 10000 AS value FROM (SELECT DISTINCT server_id, channel FROM tok WHERE is_current) c JOIN act a USING (server_id)
      LEFT JOIN (SELECT server_id, channel, day, sum(n_tokens) AS n FROM tok WHERE is_current GROUP BY 1, 2, 3) t USING (server_id, channel, day))
    WINDOW w AS (PARTITION BY server_id, channel ORDER BY day)))""")
def channel_shares(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed daily share of the community's words in each channel."""
    tokens = messages.tokenized(tables.messages(spark, d))
    rows = tokens.where("is_current").groupBy("server_id", "channel", "day").agg(F.sum(F.size("tokens")).alias("n"))
    axis = rows.select("server_id", "channel").distinct().join(messages.daily_activity(tokens).select("server_id", "day", "tokens"), "server_id")
    value = F.coalesce("n", F.lit(0)) / F.greatest("tokens", F.lit(1)) * 10000
    series = axis.join(rows, ["server_id", "channel", "day"], "left").select("server_id", "channel", "day", value.alias("value"))
    out = topics.daily_share(topics.causal(series, ["server_id", "channel"]), "channel", ["server_id"])
    return out.select("server_id", "channel", "day", F.round("value", 3).alias("value"), F.round("smooth", 6).alias("smooth"), F.round("share", 6).alias("share"))


@query(f"SELECT {MOVE} FROM cand")
def movement_candidates(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).moves()


@query(f"""SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY server_id, direction ORDER BY abs(momentum) DESC, CASE WHEN direction = 'rising' THEN recent_rate ELSE previous_rate END DESC, term)::INT AS place FROM (
  SELECT *, 0 AS r, CASE WHEN recent_rate >= 0.3 AND momentum > 0.35 THEN 'rising' WHEN previous_rate >= 0.3 AND momentum < -0.35 THEN 'fading' END AS direction FROM (SELECT {MOVE} FROM cand)) WHERE direction IS NOT NULL""")
def movement_directed(spark: SparkSession, d: str) -> DataFrame:
    return movement.directed(report(spark, d).moves())


@query("SELECT * FROM div", chain=GRAPH)
def movement_diverse(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).movement()


# ---- with a file of scaffolding words --------------------------------------

#: The same expressions with the benchmark's words as scaffolding.
TALKING = CHAIN.replace(TALK, "(SELECT w FROM talk)").replace(
    "WITH RECURSIVE", r"""WITH RECURSIVE
talk AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z][a-z''\-]{2,}')) AS w FROM benchmark),""", 1
)


def scaffolded(spark: SparkSession, d: str) -> Report:
    """A report whose scaffolding is read from a file, to which the benchmark's words were written."""
    place = f"{shared_folder(spark)}/scaffolding-{uuid.uuid4().hex}"
    words = tables.table(spark, d, "benchmark").select(F.explode(text.word_tokens(F.lower(F.coalesce("text", F.lit(""))))).alias("value"))
    words.distinct().write.text(place)
    return Report(tables.messages(spark, d), *tables.reference(spark, d), scaffolding=corpus.words_of(spark, place))


@query(LEXICON, chain=TALKING)
def lexicon_scaffolded(spark: SparkSession, d: str) -> DataFrame:
    return scaffolded(spark, d).lexicon()


@query("SELECT server_id, size::INT AS size, place::INT AS place, term, uses, voices, active_days, round(association, 3) AS association, round(reference_lift, 1) AS reference_lift FROM phr", chain=TALKING)
def phrases_scaffolded(spark: SparkSession, d: str) -> DataFrame:
    return scaffolded(spark, d).phrases()


@query("SELECT server_id, term, kind, uses, voices, documents, round(lift, 4) AS lift FROM node", chain=TALKING)
def topic_nodes_scaffolded(spark: SparkSession, d: str) -> DataFrame:
    return scaffolded(spark, d).graph()["nodes"].withColumn("lift", F.round("lift", 4))


@query(f"SELECT {MOVE} FROM cand", chain=TALKING)
def movement_scaffolded(spark: SparkSession, d: str) -> DataFrame:
    return scaffolded(spark, d).moves()


# ---- people ----------------------------------------------------------------


@query("SELECT server_id, speaker, channel, messages FROM part")
def participation(spark: SparkSession, d: str) -> DataFrame:
    return people.participation(messages.tokenized(tables.messages(spark, d))).drop("first")


@query("SELECT server_id, l, r, round(weight, 6) AS weight FROM aff")
def person_affinity(spark: SparkSession, d: str) -> DataFrame:
    return people.affinity(people.participation(messages.tokenized(tables.messages(spark, d)))).withColumn("weight", F.round("weight", 6))


@query(f"""SELECT server_id, l, r, round(weight, 6) AS weight FROM aff WHERE (server_id, l, r) IN (SELECT (server_id, l, r) FROM (
  SELECT *, row_number() OVER (PARTITION BY server_id, node ORDER BY round(weight, 9) DESC, other DESC) AS k FROM (SELECT *, l AS node, r AS other FROM aff UNION ALL SELECT *, r, l FROM aff)) WHERE k <= {DEFAULT.person_links})""")
def pruned_affinity(spark: SparkSession, d: str) -> DataFrame:
    found = people.strongest_links(people.participation(messages.tokenized(tables.messages(spark, d))), DEFAULT.person_links)
    return found.withColumn("weight", F.round("weight", 6))


@query("SELECT server_id, circle, speaker, name, messages FROM circ", chain=GRAPH)
def conversation_circles(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).circles()


@query("SELECT r.server_id, r.circle, r.place, r.channel, r.messages, l.label FROM croom r JOIN clabel l ON l.server_id = r.server_id AND l.circle = r.circle", chain=GRAPH)
def circle_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Label and channels of each circle."""
    r = report(spark, d)
    rooms = r.circle_channels()
    return rooms.join(people.circle_labels(rooms, r.mix("circle", r.circles())), ["server_id", "circle"])


@query("SELECT * FROM cmix WHERE place <= 5", chain=GRAPH)
def circle_topics(spark: SparkSession, d: str) -> DataFrame:
    r = report(spark, d)
    return r.mix("circle", r.circles()).where("place <= 5")


@query("SELECT * FROM clang", chain=GRAPH)
def circle_language(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).circle_language()


@query("SELECT * FROM rmix WHERE place <= 4", chain=GRAPH)
def channel_topics(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).mix("channel").where("place <= 4")


@query("""SELECT server_id, channel, row_number() OVER (PARTITION BY server_id, channel ORDER BY score DESC, uses DESC, term)::INT AS place, term, uses, round(lift, 1) AS lift FROM (
  SELECT *, round(ln(1 + uses) * """ + log2("lift + 1") + """ * 1.0, 9) AS score FROM (
    SELECT c.*, ((c.uses + 0.5) / (s.size + 1000)) / ((v.uses - c.uses + 0.5) / (greatest(0, t.tokens - s.size) + 1000)) AS lift
    FROM (SELECT server_id, channel, term, sum(uses)::BIGINT AS uses FROM fact WHERE is_current AND size = 1 GROUP BY 1, 2, 3) c
    JOIN lex l ON l.server_id = c.server_id AND l.term = c.term JOIN inv v ON v.server_id = c.server_id AND v.term = c.term AND v.size = 1
    JOIN (SELECT server_id, channel, sum(n_tokens) AS size FROM tok WHERE is_current GROUP BY 1, 2) s ON s.server_id = c.server_id AND s.channel = c.channel JOIN tot t ON t.server_id = c.server_id WHERE c.uses >= 3))
QUALIFY place <= 8""")
def lexicon_channel_language(spark: SparkSession, d: str) -> DataFrame:
    """Distinctive words of channels among the lexicon alone."""
    r = report(spark, d)
    counts = messages.roll_up(r.facts.where("size = 1"), "channel", "term")
    sizes = r.current.groupBy("server_id", "channel").agg(F.sum(F.size("tokens")).alias("size"))
    return people.distinctive(counts, "channel", sizes, r.observed(), r.lexicon(), r.totals, voices=False)


@query("SELECT * FROM rlang", chain=GRAPH)
def channel_language(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).channel_language()


@query("""SELECT server_id, place::INT AS place, channel, messages, voices, string_agg(name, ', ' ORDER BY k) AS people FROM (
  SELECT r.*, p.name, row_number() OVER (PARTITION BY r.server_id, r.channel ORDER BY a.messages DESC, p.name, a.speaker) AS k FROM (
    SELECT * EXCLUDE (first), row_number() OVER (PARTITION BY server_id ORDER BY messages DESC, first, channel) AS place FROM (SELECT server_id, channel, sum(messages)::BIGINT AS messages, count(*) AS voices, min(first) AS first FROM part GROUP BY 1, 2) QUALIFY place <= 10
  ) r JOIN part a USING (server_id, channel) JOIN ppl p ON p.server_id = a.server_id AND p.speaker = a.speaker QUALIFY k <= 6) GROUP BY 1, 2, 3, 4, 5""".replace("SELECT r.*", "SELECT r.server_id, r.channel, r.messages, r.voices, r.place"))
def channel_profiles(spark: SparkSession, d: str) -> DataFrame:
    r = report(spark, d)
    return people.channel_profiles(r.here, r.people()).withColumn("people", F.array_join(F.col("people.name"), ", "))


@query("SELECT * FROM pmix WHERE place <= 6", chain=GRAPH)
def person_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topic mix of each person; a report shows it under a pseudonym."""
    return report(spark, d).mix("speaker").where("place <= 6")


# ---- what the clusterings are worth ----------------------------------------

CERTIFICATE = "server_id, nodes, links, communities, modularity, best_move"
MOVES = "server_id, term, community, own, round(gain, 9) + 0.0 AS gain"


def rounded(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in names})


@query(f"SELECT {CERTIFICATE} FROM tcom_cert", chain=GRAPH)
def topic_certificate(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the topic graph's communities, and the best move that is left in it."""
    r = report(spark, d)
    return rounded(community.certificate(r.graph()["pruned"], r.topic_communities(), DEFAULT.topic_resolution), "modularity", "best_move")


@query(f"SELECT {MOVES} FROM tcom_move", chain=GRAPH)
def topic_moves(spark: SparkSession, d: str) -> DataFrame:
    r = report(spark, d)
    return rounded(community.moves(r.graph()["pruned"], r.topic_communities(), DEFAULT.topic_resolution), "gain")


@query(f"SELECT {CERTIFICATE} FROM pcom_cert", chain=GRAPH)
def circle_certificate(spark: SparkSession, d: str) -> DataFrame:
    r = report(spark, d)
    return rounded(community.certificate(r.links(), r.person_communities(), DEFAULT.circle_resolution), "modularity", "best_move")


@query(f"SELECT {MOVES} FROM pcom_move", chain=GRAPH)
def circle_moves(spark: SparkSession, d: str) -> DataFrame:
    r = report(spark, d)
    return rounded(community.moves(r.links(), r.person_communities(), DEFAULT.circle_resolution), "gain")


# ---- nested tables, flattened ----------------------------------------------


def flat(name: str, *fields: str) -> Column:
    """An array of structs as text: fields by colons, items by bars."""
    return F.coalesce(F.array_join(F.transform(name, lambda x: F.concat_ws(":", *[x[f] for f in fields])), "|"), F.lit("")).alias(name)


def flat_map(name: str) -> Column:
    return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat_ws(":", e["key"], e["value"])), "|").alias(name)


@query("""SELECT p.server_id, p.speaker, name, messages, tokens, active_days, channels AS n_channels, share, coalesce(rooms, '') AS top_channels, coalesce(about, '') AS topics, coalesce(words, '') AS words, coalesce(phrases, '') AS phrases
FROM ppl p LEFT JOIN (SELECT server_id, speaker, string_agg(channel || ':' || messages, '|' ORDER BY k) AS rooms FROM proom GROUP BY 1, 2) r ON r.server_id = p.server_id AND r.speaker = p.speaker
LEFT JOIN (SELECT server_id, speaker, string_agg(topic || ':' || label || ':' || mentions || ':' || share || ':' || lift, '|' ORDER BY place) AS about FROM pmix WHERE place <= 6 GROUP BY 1, 2) m ON m.server_id = p.server_id AND m.speaker = p.speaker
LEFT JOIN (SELECT server_id, speaker, string_agg(term || ':' || uses, '|' ORDER BY term) FILTER (WHERE size = 1) AS words, string_agg(term || ':' || uses, '|' ORDER BY term) FILTER (WHERE size > 1) AS phrases FROM said GROUP BY 1, 2) s
  ON s.server_id = p.server_id AND s.speaker = p.speaker""", chain=GRAPH)
def people_table(spark: SparkSession, d: str) -> DataFrame:
    """Every person with channels, topics and uses of published terms."""
    rows = report(spark, d).people_table()
    plain = ("server_id", "speaker", "name", "messages", "tokens", "active_days", "n_channels", "share")
    return rows.select(*plain, flat("top_channels", "channel", "messages"), flat("topics", "topic", "label", "mentions", "share", "lift"), flat_map("words"), flat_map("phrases"))


@query("""SELECT c.server_id, c.circle, c.messages, round(c.messages / greatest(t.messages, 1), 3) AS share, l.label, members, r.channels, coalesce(topics, '') AS topics, coalesce(language, '') AS language FROM (
  SELECT server_id, circle, sum(messages)::BIGINT AS messages, string_agg(name || ':' || messages, '|' ORDER BY messages DESC, name, speaker) AS members FROM circ GROUP BY 1, 2) c
JOIN tot t ON t.server_id = c.server_id LEFT JOIN clabel l ON l.server_id = c.server_id AND l.circle = c.circle
LEFT JOIN (SELECT server_id, circle, string_agg(channel || ':' || messages, '|' ORDER BY place) AS channels FROM croom GROUP BY 1, 2) r ON r.server_id = c.server_id AND r.circle = c.circle
LEFT JOIN (SELECT server_id, circle, string_agg(topic || ':' || label || ':' || mentions || ':' || share || ':' || lift, '|' ORDER BY place) AS topics FROM cmix WHERE place <= 5 GROUP BY 1, 2) m ON m.server_id = c.server_id AND m.circle = c.circle
LEFT JOIN (SELECT server_id, circle, string_agg(term || ':' || uses || ':' || voices || ':' || lift, '|' ORDER BY place) AS language FROM clang GROUP BY 1, 2) w ON w.server_id = c.server_id AND w.circle = c.circle""", chain=GRAPH)
def circle_table(spark: SparkSession, d: str) -> DataFrame:
    """Every circle with members (names; pytest holds the keys), channels, topics and words."""
    rows = report(spark, d).circle_table()
    topic = flat("topics", "topic", "label", "mentions", "share", "lift")
    return rows.select("server_id", "circle", "messages", "share", "label", flat("members", "name", "messages"), flat("channels", "channel", "messages"), topic, flat("language", "term", "uses", "voices", "lift"))


@query("""SELECT r.server_id, r.channel, r.messages, r.voices, r.place, people, coalesce(topics, '') AS topics, coalesce(language, '') AS language FROM room r
JOIN (SELECT server_id, channel, string_agg(name || ':' || messages, '|' ORDER BY k) AS people FROM roomp GROUP BY 1, 2) p ON p.server_id = r.server_id AND p.channel = r.channel
LEFT JOIN (SELECT server_id, channel, string_agg(topic || ':' || label || ':' || mentions || ':' || share || ':' || lift, '|' ORDER BY place) AS topics FROM rmix WHERE place <= 4 GROUP BY 1, 2) m ON m.server_id = r.server_id AND m.channel = r.channel
LEFT JOIN (SELECT server_id, channel, string_agg(term || ':' || uses || ':' || lift, '|' ORDER BY place) AS language FROM rlang GROUP BY 1, 2) w ON w.server_id = r.server_id AND w.channel = r.channel""", chain=GRAPH)
def channel_table(spark: SparkSession, d: str) -> DataFrame:
    """The busiest channels with people, topics and words."""
    rows = report(spark, d).channel_table()
    topic = flat("topics", "topic", "label", "mentions", "share", "lift")
    return rows.select("server_id", "channel", "messages", "voices", "place", flat("people", "name", "messages"), topic, flat("language", "term", "uses", "lift"))


@query("""SELECT f.server_id, f.speaker, f.size::INT AS size, f.term, sum(f.uses)::BIGINT AS uses FROM fact f JOIN (SELECT server_id, 1 AS size, term FROM lex UNION ALL SELECT server_id, size, term FROM phr) s
ON s.server_id = f.server_id AND s.size = f.size AND s.term = f.term WHERE is_current GROUP BY ALL""")
def contributions(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).contributions()


def silent(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, v) for s in ("de", "en", "es", "fr") for v in SILENT], "server_id string, speaker string")


GONE = """(SELECT server_id, size, term, sum(uses) AS gone, count(DISTINCT speaker) AS voices_gone FROM fact WHERE is_current AND speaker IN ('u1', 'u2', 'u3') GROUP BY 1, 2, 3)"""


@query(f"""SELECT server_id, row_number() OVER (PARTITION BY server_id ORDER BY score DESC, uses DESC, term)::INT AS place, term, uses, voices, round(expected, 4) AS expected FROM (
  SELECT *, round(ln(1 + uses) * ln(1 + voices) * {log2(f"greatest({DEFAULT.word_min_lift}, least(coalesce(lift, {DEFAULT.lift_ceiling}), {DEFAULT.lift_ceiling}))")}, 9) AS score FROM (
    SELECT l.server_id, l.term, greatest(0, l.uses - coalesce(gone, 0))::BIGINT AS uses, greatest(0, l.voices - coalesce(voices_gone, 0))::BIGINT AS voices,
      CASE WHEN rate > 0 THEN round(rate * n, 4) END * s.share AS expected, greatest(0, l.uses - coalesce(gone, 0)) / greatest(CASE WHEN rate > 0 THEN round(rate * n, 4) END * s.share, 1e-12) AS lift0,
      CASE WHEN rate > 0 THEN greatest(0, l.uses - coalesce(gone, 0)) / greatest(round(rate * n, 4) * s.share, 1e-12) END AS lift
    FROM lex l LEFT JOIN {GONE} g ON g.server_id = l.server_id AND g.size = 1 AND g.term = l.term
    JOIN (SELECT t.server_id, greatest(1, t.tokens - coalesce(x.silent, 0)) / t.tokens AS share FROM tot t LEFT JOIN (SELECT server_id, sum(tokens) AS silent FROM ppl WHERE speaker IN ('u1', 'u2', 'u3') GROUP BY 1) x USING (server_id)) s ON s.server_id = l.server_id)
  WHERE uses >= {DEFAULT.min_word_uses} AND voices >= 2 AND (lift IS NULL OR lift >= {DEFAULT.word_min_lift})) QUALIFY place <= 18""")
def lexicon_lens(spark: SparkSession, d: str) -> DataFrame:
    r = report(spark, d)
    words = r.lexicon()
    return lexicon.lexicon_lens(words, lexicon.contributions(r.facts, words, r.phrases()), r.people(), r.totals, silent(spark))


@query(f"""SELECT server_id, row_number() OVER (PARTITION BY server_id ORDER BY score DESC, uses DESC, term)::INT AS place, size::INT AS size, term, uses, voices FROM (
  SELECT *, round(ln(1 + uses) * ln(1 + voices) * association, 9) AS score FROM (
    SELECT p.server_id, p.size, p.term, round(association, 3) AS association, greatest(0, p.uses - coalesce(gone, 0))::BIGINT AS uses, greatest(0, p.voices - coalesce(voices_gone, 0))::BIGINT AS voices
    FROM phr p LEFT JOIN {GONE} g ON g.server_id = p.server_id AND g.size = p.size AND g.term = p.term)
  WHERE uses >= {DEFAULT.min_phrase_uses} AND voices >= 2) QUALIFY place <= 16""")
def phrase_lens(spark: SparkSession, d: str) -> DataFrame:
    r = report(spark, d)
    found = r.phrases()
    return lexicon.phrase_lens(found, lexicon.contributions(r.facts, r.lexicon(), found), silent(spark))


# ---- the published report --------------------------------------------------

#: Tables of a report, and what the SQL has for each.
PUBLISHED = {
    "stats": "tot",
    "activity": "act",
    "heat_map": "(SELECT server_id, unnest(range(0, 168)) AS c FROM (SELECT DISTINCT server_id FROM tok))",
    "lexicon": "lex",
    "phrases": "phr",
    "topics": "topic",
    "units": "member",
    "series": "tday",
    "edges": "vis",
    "edge_series": "(SELECT vis.* FROM vis JOIN act USING (server_id))",
    "movement": "div",
    "people": "ppl",
    "circles": "(SELECT DISTINCT server_id, circle FROM circ)",
    "channels": "room",
    "servers": "(SELECT DISTINCT server_id FROM elig)",
    "coverage": "(SELECT DISTINCT server_id FROM msg WHERE server_id IS NOT NULL)",
    "sources": "dom",
    "source_series": "(SELECT dom.* FROM dom JOIN act USING (server_id))",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n_rows, count(*) AS n_read, count(DISTINCT server_id) AS servers FROM {rows}" for name, rows in PUBLISHED.items()), chain=GRAPH)
def report_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A whole report written, published and read back: rows by the manifest and by the tables."""
    place = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    with report(spark, d) as r:
        r.write(place)
    known = sink.manifest(spark, place).select("name", "n_rows")
    back = [sink.read_table(spark, place, name).agg(F.lit(name).alias("name"), F.count("*").alias("n_read"), F.countDistinct("server_id").alias("servers")) for name in PUBLISHED]
    return known.join(reduce(DataFrame.unionByName, back), "name", "left")
