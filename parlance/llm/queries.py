"""The registered queries: each operator over its whole table, and their SQL.

A query is thin: it reads the table, applies the operator with production
parameters and derives the digest columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import ann, chat, fill_in_middle, filter_audit, fingerprints, impact_index, language_id, line_dedup, packing, sentencepiece_codec, simhash, suffix_dedup, token_counts
from parlance.llm.common import table

#: Two added rows whose texts hold escapes and marks.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = packing.place(pieces, docs.count())
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kept = line_dedup.drop_boilerplate(pages, line_dedup.url_host(F.col("url")), line_dedup.html_lines(F.col("html")))
    return kept.select("page_id", "site", "n_lines", "n_dropped", F.array_join("kept_lines", "\n").alias("text"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    return ann.search(vectors, F.col("vec_id") % 100 == 0)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), round_trip=True)
    return coded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.with_next(table(spark, sf_dir, "documents"))
    changed = pairs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "fp",
        fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        fingerprints.edited(F.col("text"), F.col("next_text")).alias("edited"),
    )
    both = fingerprints.with_fingerprint(changed.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_fp")
    return both.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprints.hex_digits(F.col("fp")).alias("fingerprint"),
        fingerprints.hex_digits(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), "near_next",
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HARD_TEXT).alias("text"),
    )
    read = chat.read_back(chat.format_conversations(rows.unionByName(hard)))
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    return impact_index.search(vectors, F.col("vec_id") % 50 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("lang"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP2_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS k, page_id, regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.\-]*://([^/?#:]+)', 1) AS site,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', '', 'g'),
      '(?i)</?(p|div|li|ul|ol|br|h[1-6]|tr|td|th|table|article|nav|header|footer|section|title|head|body|html|main|aside)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages
), n AS (SELECT site, count(*) AS pages FROM p GROUP BY site),
seen AS (SELECT DISTINCT k, site, unnest(lines) AS line FROM p),
common AS (
  SELECT seen.site, line FROM seen JOIN n USING (site) GROUP BY seen.site, line, pages
  HAVING count(*) >= 5 AND count(*) * 100 > pages * 10
), one AS (
  SELECT k, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, site FROM p
), kept AS (
  SELECT k, string_agg(one.line, chr(10) ORDER BY i) AS text, count(*) AS n
  FROM one LEFT JOIN common c ON one.site = c.site AND one.line = c.line WHERE c.line IS NULL GROUP BY k
)
SELECT page_id, site, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(kept.n, 0))::BIGINT AS n_dropped, coalesce(text, '') AS text
FROM p LEFT JOIN kept USING (k)
"""

OP10_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM r
), e AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
    replace(replace(text, '\', '\\'), '<', '\l') AS body,
    replace(replace(replace(role, '\', '\\'), '<', '\l'), chr(10), '\n') AS name
  FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY n)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + CASE WHEN before IS NOT DISTINCT FROM role THEN 6 ELSE 7 + length(name) END
    + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 8 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP11_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.z, c.z)::BIGINT AS score,
    row_number() OVER (PARTITION BY q.n ORDER BY list_inner_product(q.z, c.z) DESC, c.vec_id)::INT AS rank
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0
) WHERE rank <= 5
"""

OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
known AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, first IS NOT NULL)] AS fails
  FROM w LEFT JOIN known USING (doc_id)
),
f AS (SELECT unnest(range(1, 6)) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS nth FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
),
s AS (SELECT array_to_string(list_transform(nth, lambda i: 'ABCDE'[i]), '') AS filter_order, step::INT AS step, nth[step] AS own, nth[:step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE NOT fails[own] AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE fails[own] AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE fails[own] AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE fails[own] AND len(list_filter(fails, lambda x: x)) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE fails[own] AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE fails[own] AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM (SELECT g.*, s.*, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone FROM g, s) GROUP BY part, filter_order, step, own
)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT *, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
y AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM x
),
z AS (SELECT *, substring(t, 1, lo) AS pre, substring(t, lo + 1, hi - lo) AS mid, substring(t, hi + 1, n - hi) AS suf FROM y)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM z
"""

QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_line_dedup, op3_ann, op4_simhash, op5_token_counts, op6_sentencepiece, op7_suffix_array, op8_fingerprints, op9_language_id, op10_chat, op11_exact_top_k, op12_filter_audit, op13_fill_in_middle)
}
ORACLE_SQL = {"op2_line_dedup": OP2_SQL, "op10_chat": OP10_SQL, "op11_exact_top_k": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
