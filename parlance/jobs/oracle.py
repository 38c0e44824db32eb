"""SQL for the registered queries, in one chain of common table expressions.

Each query is the chain and a final SELECT; an engine runs what is referred to.
"""

from __future__ import annotations

from parlance.config import DEFAULT as S
from parlance.functions.words import PLATFORM_WORDS, STOPWORDS


def listed(words: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


STOP, PLATFORM, TALK, EXCLUDED = listed(STOPWORDS), listed(PLATFORM_WORDS), listed(S.scaffolding or ('',)), listed(S.excluded_words)
REPORTABLE = f"(length(term) >= 3 AND term NOT IN {STOP} AND term NOT IN {PLATFORM} AND term NOT IN {EXCLUDED} AND NOT contains(term, '''') AND NOT starts_with(term, 'http'))"


def log2(x: str) -> str:
    return f"(ln({x}) / ln(2.0))"


def fold(term: str) -> str:
    """SQL array of singular candidates of a word, in order."""
    return f"""[CASE WHEN length({term}) > 4 AND ends_with({term}, 'ies') THEN {term}[:-4] || 'y' END,
      CASE WHEN length({term}) > 4 AND regexp_matches({term}, '(sses|xes|zes|ches|shes)$') THEN {term}[:-3] END,
      CASE WHEN length({term}) > 3 AND ends_with({term}, 's') AND NOT regexp_matches({term}, '(ss|us|is)$') THEN {term}[:-2] END]"""


def tokens_of(rows: str, name: str) -> str:
    """CTEs that cut the ``clean`` text of ``rows`` into words and gaps."""
    return f"""
{name}_cut AS MATERIALIZED (
  SELECT *, regexp_extract_all(clean, '[a-z][a-z''\\-]{{2,}}') AS tk, regexp_split_to_array(clean, '[a-z][a-z''\\-]{{2,}}') AS gp
  FROM (SELECT *, lower(regexp_replace(regexp_replace(coalesce(message, ''), '<a?:\\w+:\\d+>|<[@#][!&]?\\d+>', chr(10), 'g'), 'https?://[^\\s<>]+', chr(10), 'gi')) AS clean FROM {rows})
),
{name}_word AS MATERIALIZED (
  SELECT * EXCLUDE (gap), NOT regexp_full_match(gap, '\\s+') OR contains(gap, chr(10)) AS brk FROM (
    SELECT id, unnest(tk) AS w, generate_subscripts(tk, 1) - 1 AS pos, unnest(gp[2:]) AS gap FROM {name}_cut WHERE len(tk) > 0)
),
{name}_next AS MATERIALIZED (
  SELECT *, lead(w) OVER i AS w2, lead(w, 2) OVER i AS w3, lead(brk) OVER i AS brk2 FROM {name}_word WINDOW i AS (PARTITION BY id ORDER BY pos)
),
{name}_gram AS (
  SELECT id, pos, 1 AS size, w AS term FROM {name}_word
  UNION ALL SELECT id, pos, 2, w || ' ' || w2 FROM {name}_next
    WHERE w2 IS NOT NULL AND NOT brk AND w NOT IN {STOP} AND w2 NOT IN {STOP} AND w NOT IN {PLATFORM} AND w2 NOT IN {PLATFORM}
  UNION ALL SELECT id, pos, 3, w || ' ' || w2 || ' ' || w3 FROM {name}_next
    WHERE w3 IS NOT NULL AND NOT brk AND NOT brk2 AND w NOT IN {STOP} AND w3 NOT IN {STOP} AND w NOT IN {PLATFORM} AND w2 NOT IN {PLATFORM} AND w3 NOT IN {PLATFORM}
)"""


def gated(inventory: str, words: str, totals: str, name: str) -> str:
    return f"""
{name}_part AS (
  SELECT server_id, size, term, uses, voices, active_days, first_ts, unnest(string_split(term, ' ')) AS word, generate_subscripts(string_split(term, ' '), 1) AS spot
  FROM {inventory} WHERE size > 1 AND uses >= {S.min_phrase_uses} AND voices >= {S.min_voices}
),
{name} AS (
  SELECT *, {log2("p / greatest(alone, 1e-18)")} / greatest(1e-12, -{log2("p")}) AS association FROM (
    SELECT g.*, g.uses / greatest(t.tokens - (g.size - 1) * t.messages, 1) AS p, CASE WHEN size = 2 THEN (u0 / greatest(t.tokens, 1)) * (u1 / greatest(t.tokens, 1))
      ELSE (u0 / greatest(t.tokens, 1)) * (u1 / greatest(t.tokens, 1)) * (u2 / greatest(t.tokens, 1)) END AS alone
    FROM (
      SELECT p.server_id, p.size, p.term, any_value(p.uses) AS uses, any_value(p.voices) AS voices, any_value(p.active_days) AS active_days, any_value(p.first_ts) AS first_ts,
        max(v.uses) FILTER (WHERE spot = 1) AS u0, max(v.uses) FILTER (WHERE spot = 2) AS u1, max(v.uses) FILTER (WHERE spot = 3) AS u2,
        bool_or(word NOT IN {STOP} AND NOT v.reportable) AS unfit, bool_and(word IN {STOP} OR v.scaffolding) AS empty,
        count(DISTINCT word) FILTER (WHERE word NOT IN {STOP} AND v.about) AS subjects
      FROM {name}_part p JOIN {words} v ON v.server_id = p.server_id AND v.term = p.word GROUP BY p.server_id, p.size, p.term
    ) g JOIN {totals} t USING (server_id) WHERE NOT unfit AND NOT empty
  ) WHERE {log2("p / greatest(alone, 1e-18)")} / greatest(1e-12, -{log2("p")}) > 0
)"""


CHAIN = f"""WITH RECURSIVE
msg AS (
  SELECT doc_id, 'doc:' || doc_id AS id, lang AS server_id, 'Server ' || lang AS server, source AS channel, 'u' || (doc_id * 7919 % 41) AS user_id, 'Thing ' || (doc_id * 7919 % 41) AS "user",
    doc_id % 17 = 0 AS is_bot, text AS message, TIMESTAMP '2024-01-01' + to_minutes((doc_id * 7919 % 302400)::INT) AS ts FROM documents
),
elig AS MATERIALIZED (
  SELECT *, user_id AS speaker, ts::DATE AS day, date_trunc('week', ts)::DATE AS week, ts >= max(ts) OVER (PARTITION BY server_id) - INTERVAL {S.days - 1} DAY AS is_current
  FROM msg WHERE NOT is_bot AND server_id IS NOT NULL
),{tokens_of("elig", "t")},
tok AS MATERIALIZED (SELECT * EXCLUDE (clean, message, gp), len(tk) AS n_tokens FROM t_cut),
alias AS (SELECT DISTINCT server_id, unnest(regexp_extract_all(lower("user"), '[a-z][a-z''\\-]{{2,}}')) AS alias FROM elig),
fact AS MATERIALIZED (
  SELECT server_id, size, term, speaker, channel, day, week, is_current, count(*) AS uses, min(ts) AS first_ts FROM t_gram JOIN tok USING (id) GROUP BY ALL
),
inv AS MATERIALIZED (SELECT server_id, size, term, sum(uses)::BIGINT AS uses, count(DISTINCT speaker) AS voices, count(DISTINCT day) AS active_days, min(first_ts) AS first_ts FROM fact WHERE is_current GROUP BY ALL),
hist AS MATERIALIZED (SELECT server_id, size, term, sum(uses)::BIGINT AS uses, count(DISTINCT speaker) AS voices, count(DISTINCT day) AS active_days, min(first_ts) AS first_ts FROM fact GROUP BY ALL),
tot AS MATERIALIZED (SELECT server_id, count(*) AS messages, sum(n_tokens)::BIGINT AS tokens, count(DISTINCT speaker) AS voices, count(DISTINCT channel) AS channels, min(ts) AS first_ts, max(ts) AS last_ts FROM tok WHERE is_current GROUP BY 1),
alltot AS MATERIALIZED (SELECT server_id, count(*) AS messages, sum(n_tokens)::BIGINT AS tokens, count(DISTINCT speaker) AS voices, count(DISTINCT channel) AS channels, min(ts) AS first_ts, max(ts) AS last_ts FROM tok GROUP BY 1),
axis AS (SELECT server_id, unnest(range(0, {S.days}))::INT AS k, max(ts)::DATE AS d FROM tok GROUP BY server_id),
act AS (
  SELECT a.server_id, a.day, coalesce(messages, 0)::BIGINT AS messages, coalesce(tokens, 0)::BIGINT AS tokens, coalesce(voices, 0)::BIGINT AS voices
  FROM (SELECT server_id, d - k AS day FROM axis) a LEFT JOIN (
    SELECT server_id, day, count(*) AS messages, sum(n_tokens) AS tokens, count(DISTINCT speaker) AS voices FROM tok WHERE is_current GROUP BY 1, 2) USING (server_id, day)
),
bench AS (SELECT item_id AS id, text AS message FROM benchmark),{tokens_of("bench", "b")},
refw AS MATERIALIZED (SELECT w AS term, count(*) AS cnt FROM b_word GROUP BY 1),
refb AS MATERIALIZED (SELECT term, count(*) AS cnt FROM b_gram WHERE size = 2 GROUP BY 1),
rate AS MATERIALIZED (
  SELECT x.term, coalesce(nullif(a.cnt, 0), b.cnt, 0) / (SELECT greatest(sum(cnt), 1) FROM refw) AS rate
  FROM (SELECT DISTINCT term FROM hist WHERE size = 1 UNION SELECT unnest({fold("term")}) FROM hist WHERE size = 1) x
  LEFT JOIN refw a ON a.term = x.term LEFT JOIN refw b ON b.term = replace(replace(x.term, '''', ''), '-', '') WHERE x.term IS NOT NULL
),
voc AS MATERIALIZED (
  SELECT *, reportable AND NOT scaffolding AND (rate = 0 OR (rate * 1e6 <= {S.max_reference_ppm} AND lift >= {S.topic_min_lift})) AS about FROM (
    SELECT i.*, t.tokens AS n, r.rate, (i.uses / greatest(t.tokens, 1)) / greatest(r.rate, 1e-8) AS lift,
      {REPORTABLE.replace("term", "i.term")} AND a.alias IS NULL AS reportable, i.term IN {TALK} AS scaffolding
    FROM inv i JOIN tot t USING (server_id) JOIN rate r ON r.term = i.term LEFT JOIN alias a ON a.server_id = i.server_id AND a.alias = i.term WHERE size = 1)
),
lex AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY score DESC, uses DESC, term) AS place FROM (
    SELECT *, round(ln(1 + uses) * ln(1 + voices) * {log2(f"greatest({S.word_min_lift}, least(CASE WHEN rate > 0 THEN lift ELSE {S.lift_ceiling} END, {S.lift_ceiling}))")}, 9) AS score
    FROM voc WHERE reportable AND NOT scaffolding AND uses >= {S.min_word_uses} AND voices >= {S.min_voices} AND (rate = 0 OR lift >= {S.word_min_lift}))
  QUALIFY place <= {S.top_terms}
),{gated("inv", "voc", "tot", "gate")},
phr AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY server_id, size ORDER BY score DESC, uses DESC, term) AS place FROM (
    SELECT g.*, coalesce(b.cnt, 0) / (SELECT greatest(sum(cnt), 1) FROM refb) AS brate, CASE WHEN size = 2 THEN p / greatest(coalesce(b.cnt, 0) / (SELECT greatest(sum(cnt), 1) FROM refb), 1e-10) END AS reference_lift,
      round(ln(1 + uses) * ln(1 + voices) * association, 9) AS score
    FROM gate g LEFT JOIN refb b USING (term))
  WHERE CASE WHEN size = 2 THEN brate = 0 OR reference_lift >= {S.bigram_min_lift} ELSE subjects >= {S.trigram_min_subjects} END
  QUALIFY place <= {S.top_terms}
),
big AS MATERIALIZED (SELECT server_id, term, round(association, 3) AS association, round(reference_lift, 1) AS reference_lift, uses, voices, active_days FROM phr WHERE size = 2 AND uses >= {S.unit_min_uses} AND voices >= {S.unit_min_voices} AND active_days >= {S.unit_min_days}),
claim AS MATERIALIZED (
  SELECT id, pos, term FROM (
    SELECT *, row_number() OVER (PARTITION BY id, pos - n ORDER BY pos) AS k FROM (
      SELECT x.id, x.pos, x.w || ' ' || x.w2 AS term, row_number() OVER (PARTITION BY x.id ORDER BY x.pos) AS n
      FROM t_next x JOIN tok ON tok.id = x.id JOIN big ON big.server_id = tok.server_id AND big.term = x.w || ' ' || x.w2 WHERE x.w2 IS NOT NULL AND NOT x.brk AND tok.is_current))
  WHERE k % 2 = 1
),
unit AS MATERIALIZED (
  SELECT tok.id, server_id, speaker, channel, day, u.* EXCLUDE (id) FROM (
    SELECT id, term, 'bigram' AS kind, pos AS s, pos + 1 AS e, true AS content FROM claim
    UNION ALL SELECT t.id, w, 'word', t.pos, t.pos, w NOT IN {STOP} AND w NOT IN {PLATFORM} FROM t_word t
      LEFT JOIN claim a ON a.id = t.id AND a.pos = t.pos LEFT JOIN claim b ON b.id = t.id AND b.pos = t.pos - 1 WHERE a.id IS NULL AND b.id IS NULL
  ) u JOIN tok ON tok.id = u.id WHERE is_current
),
ufact AS MATERIALIZED (
  SELECT server_id, term, kind, speaker, channel, day, count(*) AS uses, count(DISTINCT id) FILTER (WHERE content) AS documents FROM unit GROUP BY ALL
),
canon AS MATERIALIZED (
  SELECT server_id, term, arg_min(c, k) AS canonical FROM (
    SELECT server_id, term, unnest({fold("term")}) AS c, unnest([1, 2, 3]) AS k FROM (SELECT DISTINCT server_id, term FROM unit WHERE kind = 'word'))
  JOIN (SELECT server_id, term AS c FROM inv WHERE size = 1) USING (server_id, c) GROUP BY 1, 2
),
cfact AS MATERIALIZED (
  SELECT u.* REPLACE (CASE WHEN kind = 'word' THEN coalesce(canonical, u.term) ELSE u.term END AS term) FROM ufact u LEFT JOIN canon c ON c.server_id = u.server_id AND c.term = u.term
),
uinv AS MATERIALIZED (
  SELECT server_id, term, kind, sum(uses)::BIGINT AS uses, count(DISTINCT speaker) AS voices, least(sum(documents), any_value(messages))::BIGINT AS documents
  FROM cfact JOIN (SELECT server_id, messages FROM tot) USING (server_id) GROUP BY 1, 2, 3
),
node AS MATERIALIZED (
  SELECT * EXCLUDE (interest, k) FROM (
    SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY interest DESC, term DESC) AS k FROM (
      SELECT server_id, term, kind, uses, voices, documents, lift, round(ln(1 + uses) * ln(1 + voices) * (1 + least(8.0, greatest(0.0, {log2("greatest(1.0, lift)")}))), 9) AS interest FROM (
        SELECT i.*, r.rate, (i.uses / greatest(t.tokens, 1)) / greatest(r.rate, 1e-8) AS lift FROM uinv i JOIN tot t USING (server_id) JOIN rate r ON r.term = i.term
        WHERE kind = 'word' AND NOT EXISTS (SELECT 1 FROM alias a WHERE a.server_id = i.server_id AND a.alias = i.term))
      WHERE uses >= {S.min_word_uses} AND voices >= {S.min_voices} AND {REPORTABLE} AND term NOT IN {TALK} AND (rate = 0 OR (rate * 1e6 <= {S.max_reference_ppm} AND lift >= {S.topic_min_lift}))))
  WHERE k <= {S.top_nodes}
  UNION ALL SELECT i.server_id, i.term, i.kind, i.uses, i.voices, i.documents, coalesce(b.reference_lift, 1.0) FROM uinv i JOIN big b ON b.server_id = i.server_id AND b.term = i.term WHERE kind = 'bigram'
),
mate AS MATERIALIZED (
  SELECT DISTINCT x.id, x.server_id, x.day, least(x.term, y.term) AS l, greatest(x.term, y.term) AS r, x.kind AS xk
  FROM unit x JOIN unit y ON x.id = y.id AND y.s > x.e AND y.s - x.e <= {S.pair_distance} AND x.term <> y.term WHERE x.content AND y.content
),
pair AS MATERIALIZED (
  SELECT server_id, day, least(a, b) AS l, greatest(a, b) AS r, count(*) AS documents FROM (
    SELECT m.server_id, m.day, coalesce(x.canonical, m.l) AS a, coalesce(y.canonical, m.r) AS b FROM (SELECT DISTINCT id, server_id, day, l, r FROM mate) m
    LEFT JOIN canon x ON x.server_id = m.server_id AND x.term = m.l LEFT JOIN canon y ON y.server_id = m.server_id AND y.term = m.r)
  WHERE a <> b AND (server_id, a) IN (SELECT (server_id, term) FROM node) AND (server_id, b) IN (SELECT (server_id, term) FROM node) GROUP BY ALL
),
comp AS MATERIALIZED (
  SELECT DISTINCT b.server_id, phrase, association, least(phrase, b.term) AS l, greatest(phrase, b.term) AS r FROM (
    SELECT b.server_id, b.term AS phrase, association, coalesce(c.canonical, b.w) AS term FROM (SELECT server_id, term, association, unnest(string_split(term, ' ')) AS w FROM big) b
    LEFT JOIN (SELECT server_id, term, arg_min(c, k) AS canonical FROM (
      SELECT server_id, w AS term, unnest({fold("w")}) AS c, unnest([1, 2, 3]) AS k FROM (SELECT DISTINCT server_id, unnest(string_split(term, ' ')) AS w FROM big))
      JOIN (SELECT server_id, term AS c FROM inv WHERE size = 1) USING (server_id, c) GROUP BY 1, 2) c ON c.server_id = b.server_id AND c.term = b.w
  ) b JOIN node n ON n.server_id = b.server_id AND n.term = b.term
),
eday AS MATERIALIZED (
  SELECT coalesce(p.server_id, c.server_id) AS server_id, coalesce(p.day, c.day) AS day, coalesce(p.l, c.l) AS l, coalesce(p.r, c.r) AS r, association, coalesce(p.documents, 0) AS seen, coalesce(made, 0) AS made
  FROM pair p FULL JOIN (
    SELECT k.server_id, d.day, k.l, k.r, k.association, d.made FROM comp k JOIN (SELECT server_id, term, day, sum(documents) AS made FROM ufact WHERE kind = 'bigram' GROUP BY 1, 2, 3) d ON d.server_id = k.server_id AND d.term = k.phrase
  ) c ON p.server_id = c.server_id AND p.day = c.day AND p.l = c.l AND p.r = c.r
),
edge AS MATERIALIZED (
  SELECT server_id, l, r, documents, association, association * ln(1 + documents) AS weight, CASE WHEN made_association IS NULL THEN 'observed_context' ELSE 'composition' END AS relation FROM (
    SELECT e.*, coalesce(made_association, {log2("(e.documents / m) / greatest(a.documents / m * b.documents / m, 1e-18)")} / greatest(1e-12, -{log2("e.documents / m")})) AS association
    FROM (SELECT server_id, l, r, greatest(sum(seen), sum(made))::BIGINT AS documents, max(association) AS made_association FROM eday GROUP BY 1, 2, 3) e
    JOIN node a ON a.server_id = e.server_id AND a.term = e.l JOIN node b ON b.server_id = e.server_id AND b.term = e.r JOIN (SELECT server_id, greatest(messages, 1) AS m FROM tot) t ON t.server_id = e.server_id
    WHERE e.documents >= {S.min_pair_documents})
  WHERE association >= {S.min_association}
),
pruned AS MATERIALIZED (
  SELECT * FROM edge WHERE (server_id, l, r) IN (SELECT (server_id, l, r) FROM (
    SELECT *, row_number() OVER (PARTITION BY server_id, node ORDER BY round(weight, 9) DESC, other DESC) AS k FROM (
      SELECT server_id, l, r, weight, l AS node, r AS other FROM edge UNION ALL SELECT server_id, l, r, weight, r, l FROM edge)) WHERE k <= {S.node_links})
),
span AS MATERIALIZED (
  SELECT server_id, min(week) AS first_week, max(week) AS last_week FROM tok GROUP BY 1
),
per AS MATERIALIZED (
  SELECT server_id, first_week, last_week, sum(CASE WHEN age < {S.trend_weeks} THEN n_tokens ELSE 0 END)::BIGINT AS recent_tokens,
    sum(CASE WHEN age >= {S.trend_weeks} AND age < {2 * S.trend_weeks} THEN n_tokens ELSE 0 END)::BIGINT AS previous_tokens, (last_week - first_week) / 7 + 1 >= {2 * S.trend_weeks} AS ready
  FROM (SELECT tok.*, first_week, last_week, (last_week - week) // 7 AS age FROM tok JOIN span USING (server_id)) GROUP BY 1, 2, 3
),
hvoc AS MATERIALIZED (
  SELECT h.server_id, h.term, uses, {REPORTABLE.replace("term", "h.term")} AND a.alias IS NULL AS reportable, h.term IN {TALK} AS scaffolding, false AS about
  FROM hist h LEFT JOIN alias a ON a.server_id = h.server_id AND a.alias = h.term WHERE size = 1
),{gated("hist", "hvoc", "alltot", "hgate")},
cand AS MATERIALIZED (
  SELECT *, round({log2("((recent_uses + 0.5) / (recent_tokens + 1000)) / ((previous_uses + 0.5) / (previous_tokens + 1000))")}, 9) AS momentum,
    CASE WHEN previous_uses = 0 AND recent_uses > 0 THEN NULL WHEN recent_uses = 0 AND previous_uses > 0 THEN -100 ELSE round_even((rr / greatest(pr, 1e-12) - 1) * 100, 0)::BIGINT END AS change_percent
  FROM (
    SELECT c.*, p.recent_tokens, p.previous_tokens, m.recent_uses, m.previous_uses, m.recent_uses / greatest(recent_tokens, 1) * 10000 AS rr, m.previous_uses / greatest(previous_tokens, 1) * 10000 AS pr
    FROM (
      SELECT h.server_id, h.size, h.term, h.uses, h.voices, h.first_ts, NULL::DOUBLE AS association FROM hist h JOIN hvoc v ON v.server_id = h.server_id AND v.term = h.term
        WHERE h.size = 1 AND h.uses >= {S.min_word_uses} AND h.voices >= {S.min_voices} AND v.reportable AND NOT v.scaffolding
      UNION ALL SELECT server_id, size, term, uses, voices, first_ts, association FROM hgate
    ) c JOIN (SELECT * FROM per WHERE ready) p USING (server_id) JOIN (
      SELECT server_id, size, term, sum(CASE WHEN age < {S.trend_weeks} THEN uses ELSE 0 END)::BIGINT AS recent_uses, sum(CASE WHEN age >= {S.trend_weeks} AND age < {2 * S.trend_weeks} THEN uses ELSE 0 END)::BIGINT AS previous_uses
      FROM (SELECT f.*, (last_week - week) // 7 AS age FROM fact f JOIN span USING (server_id)) GROUP BY 1, 2, 3
    ) m ON m.server_id = c.server_id AND m.size = c.size AND m.term = c.term)
),
part AS MATERIALIZED (SELECT server_id, speaker, channel, count(*) AS messages, min((ts, id)) AS first FROM tok WHERE is_current GROUP BY ALL),
pe AS MATERIALIZED (
  SELECT *, count(*) OVER (PARTITION BY server_id, channel) AS members FROM (SELECT *, sum(messages) OVER (PARTITION BY server_id, speaker) AS every FROM part) WHERE every >= 3
),
aff AS MATERIALIZED (
  SELECT l.server_id, l.speaker AS l, r.speaker AS r, sum(sqrt(l.messages * r.messages) / {log2("2 + l.members")}) AS weight
  FROM pe l JOIN pe r ON l.server_id = r.server_id AND l.channel = r.channel AND l.speaker < r.speaker GROUP BY 1, 2, 3
),
ppl AS MATERIALIZED (
  SELECT *, round(messages / sum(messages) OVER (PARTITION BY server_id), 4) AS share FROM (
    SELECT server_id, speaker, arg_max("user", (ts, id)) AS name, count(*) AS messages, sum(n_tokens)::BIGINT AS tokens, count(DISTINCT day) AS active_days, count(DISTINCT channel) AS channels FROM tok WHERE is_current GROUP BY 1, 2)
)
"""

MOVE = """server_id, size::INT AS size, term, uses, voices, recent_uses, previous_uses, round(rr, 3) AS recent_rate, round(pr, 3) AS previous_rate,
  CASE WHEN change_percent IS NULL THEN 'new' WHEN recent_uses = 0 AND previous_uses > 0 THEN 'not seen recently' WHEN change_percent >= 0 THEN change_percent || '% higher' ELSE -change_percent || '% lower' END AS change,
  change_percent, momentum, round(association, 3) AS association, first_ts::DATE AS first_observed"""
