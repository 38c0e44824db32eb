"""SQL for what follows from communities: topics, mixes, circles, people, channels.

The clustering itself is a recursive expression: one step offers one node the
communities of its neighbours, so the state is one row a server.
"""

from __future__ import annotations

from parlance.config import DEFAULT as S
from parlance.jobs.oracle import CHAIN, MOVE, fold, log2
from parlance.operators.community import NEAR, SWEEPS


def strongest(rows: str, top: int) -> str:
    return f"""SELECT * FROM {rows} WHERE (server_id, l, r) IN (SELECT (server_id, l, r) FROM (
    SELECT *, row_number() OVER (PARTITION BY server_id, node ORDER BY round(weight, 9) DESC, other DESC) AS k FROM (
      SELECT server_id, l, r, weight, l AS node, r AS other FROM {rows} UNION ALL SELECT server_id, l, r, weight, r, l FROM {rows})) WHERE k <= {top})"""


def communities(edges: str, resolution: float, name: str) -> str:
    """CTEs that end in ``{name}`` (server_id, term, community)."""
    return f"""
{name}_end AS MATERIALIZED (SELECT server_id, l AS term, r AS other, weight FROM {edges} UNION ALL SELECT server_id, r, l, weight FROM {edges}),
{name}_no AS MATERIALIZED (SELECT server_id, term, row_number() OVER (PARTITION BY server_id ORDER BY term)::INT AS i FROM (SELECT DISTINCT server_id, term FROM {name}_end)),
{name}_near AS MATERIALIZED (
  SELECT e.server_id, a.i, list(b.i ORDER BY b.i) AS o, list(e.weight ORDER BY b.i) AS w, list_sum(list(e.weight ORDER BY b.i)) AS degree
  FROM {name}_end e JOIN {name}_no a ON a.server_id = e.server_id AND a.term = e.term JOIN {name}_no b ON b.server_id = e.server_id AND b.term = e.other GROUP BY e.server_id, a.i
),
{name}_net AS MATERIALIZED (
  SELECT server_id, list(o ORDER BY i) AS o, list(w ORDER BY i) AS w, list(degree ORDER BY i) AS degree, list(i ORDER BY round(degree, 9) DESC, i) AS turn, sum(degree) AS whole, count(*)::INT AS n FROM {name}_near GROUP BY 1
),
{name}_step AS (
  SELECT server_id, 0 AS step, range(1, n + 1)::INT[] AS mine, degree AS total, false AS moved, false AS done FROM {name}_net
  UNION ALL
  SELECT server_id, step + 1, list_transform(mine, lambda x, i: CASE WHEN i = v THEN pick ELSE x END),
    list_transform(rest, lambda x, i: CASE WHEN i = pick THEN x + d ELSE x END), CASE WHEN last THEN false ELSE moved OR pick <> own END, last AND (NOT (moved OR pick <> own) OR step + 1 = {SWEEPS} * n)
  FROM (
    SELECT *, list_min(list_filter(choice, lambda c, i: gain[i] >= list_max(gain) - {NEAR})) AS pick FROM (
      SELECT *, list_transform(choice, lambda c: CASE WHEN c = own THEN greatest(0.0, coalesce(list_sum(list_transform(list_filter(list_zip(o[v], w[v]), lambda z: mine[z[1]] = c), lambda z: z[2])), 0.0) - pull * rest[c])
          ELSE list_sum(list_transform(list_filter(list_zip(o[v], w[v]), lambda z: mine[z[1]] = c), lambda z: z[2])) - pull * rest[c] END) AS gain FROM (
        SELECT *, list_transform(total, lambda x, i: CASE WHEN i = own THEN x - d ELSE x END) AS rest, list_distinct(list_append(list_transform(o[v], lambda j: mine[j]), own)) AS choice FROM (
          SELECT *, mine[v] AS own, degree[v] AS d, {resolution} * degree[v] / greatest(whole, {NEAR}) AS pull FROM (
            SELECT s.step, s.mine, s.total, s.moved, net.*, net.turn[s.step % net.n + 1] AS v, (s.step + 1) % net.n = 0 AS last FROM {name}_step s JOIN {name}_net net ON net.server_id = s.server_id WHERE NOT s.done)))))
),
{name} AS MATERIALIZED (
  SELECT m.server_id, a.term, b.term AS community FROM (SELECT server_id, unnest(mine) AS c, generate_subscripts(mine, 1) AS i FROM {name}_step WHERE done) m
  JOIN {name}_no a ON a.server_id = m.server_id AND a.i = m.i JOIN {name}_no b ON b.server_id = m.server_id AND b.i = m.c
)"""


def worth(name: str, resolution: float) -> str:
    """CTEs {name}_move (gain of each term in each neighbouring community) and {name}_cert."""
    return f"""
{name}_deg AS MATERIALIZED (SELECT e.server_id, e.term, any_value(c.community) AS home, sum(weight) AS degree FROM {name}_end e JOIN {name} c ON c.server_id = e.server_id AND c.term = e.term GROUP BY 1, 2),
{name}_tot AS (SELECT server_id, home AS community, sum(degree) AS total FROM {name}_deg GROUP BY 1, 2),
{name}_all AS (SELECT server_id, sum(degree) AS whole FROM {name}_deg GROUP BY 1),
{name}_move AS MATERIALIZED (
  SELECT i.server_id, i.term, i.community, i.community = home AS own, inside - {resolution} * degree * (total - CASE WHEN i.community = home THEN degree ELSE 0 END) / whole AS gain
  FROM (SELECT e.server_id, e.term, c.community, sum(weight) AS inside FROM {name}_end e JOIN {name} c ON c.server_id = e.server_id AND c.term = e.other GROUP BY 1, 2, 3) i
  JOIN {name}_deg d ON d.server_id = i.server_id AND d.term = i.term JOIN {name}_tot t ON t.server_id = i.server_id AND t.community = i.community JOIN {name}_all a ON a.server_id = i.server_id
),
{name}_cert AS (
  SELECT g.server_id, nodes, links, communities, round(modularity, 9) + 0.0 AS modularity, round(best_move, 9) + 0.0 AS best_move FROM (
    SELECT t.server_id, count(*) AS communities, sum(coalesce(inside, 0) / whole - {resolution} * (total / whole) * (total / whole)) AS modularity FROM {name}_tot t JOIN {name}_all a ON a.server_id = t.server_id
    LEFT JOIN (SELECT e.server_id, x.community, sum(weight) AS inside FROM {name}_end e JOIN {name} x ON x.server_id = e.server_id AND x.term = e.term JOIN {name} y ON y.server_id = e.server_id AND y.term = e.other AND y.community = x.community GROUP BY 1, 2) i
      ON i.server_id = t.server_id AND i.community = t.community GROUP BY 1) g
  JOIN (SELECT server_id, count(*) AS nodes, max(more) AS best_move FROM (
    SELECT server_id, term, max(gain) FILTER (WHERE NOT own) - greatest(coalesce(max(gain) FILTER (WHERE own), 0), 0) AS more FROM {name}_move GROUP BY 1, 2) GROUP BY 1) m ON m.server_id = g.server_id
  JOIN (SELECT server_id, count(*) // 2 AS links FROM {name}_end GROUP BY 1) l ON l.server_id = g.server_id
)"""


def mix(key: str, rows: str, name: str) -> str:
    """CTE ``{name}``: the topic mix of each ``key`` of ``rows`` (server_id, key, term, kind, uses)."""
    return f"""
{name} AS MATERIALIZED (
  SELECT server_id, {key}, topic, label, mentions, round(share, 3) AS share, round(share / greatest(all_share, 1e-9), 2) AS lift, row_number() OVER (PARTITION BY server_id, {key} ORDER BY mentions DESC, label, topic)::INT AS place FROM (
    SELECT *, mentions / sum(mentions) OVER (PARTITION BY server_id, {key}) AS share, all_mentions / sum(all_mentions) OVER (PARTITION BY server_id, {key}) AS all_share FROM (
      SELECT r.server_id, r.{key}, s.topic, s.label, sum(r.uses)::BIGINT AS mentions, any_value(all_mentions) AS all_mentions FROM {rows} r JOIN shown s ON s.server_id = r.server_id AND s.term = r.term AND s.kind = r.kind
      JOIN (SELECT server_id, topic, label, sum(uses) AS all_mentions FROM shown GROUP BY 1, 2, 3) w ON w.server_id = s.server_id AND w.topic = s.topic AND w.label = s.label GROUP BY 1, 2, 3, 4))
)"""


def distinctive(key: str, counts: str, sizes: str, voices: bool, name: str) -> str:
    """CTE ``{name}``: words that a subset uses more than the rest of its community."""
    more = "c.voices, " if voices else ""
    weigh = "ln(1 + voices)" if voices else "1.0"
    gate = "AND c.voices >= least(2, c.members)" if voices else ""
    return f"""
{name} AS MATERIALIZED (
  SELECT server_id, {key}, row_number() OVER (PARTITION BY server_id, {key} ORDER BY score DESC, uses DESC, term)::INT AS place, term, uses, {"voices, " if voices else ""}round(lift, 1) AS lift FROM (
    SELECT *, round(ln(1 + uses) * {log2("lift + 1")} * {weigh}, 9) AS score FROM (
      SELECT c.server_id, c.{key}, c.term, c.uses, {more}((c.uses + 0.5) / (s.size + 1000)) / ((v.uses - c.uses + 0.5) / (greatest(0, t.tokens - s.size) + 1000)) AS lift
      FROM {counts} c JOIN allowed l ON l.server_id = c.server_id AND l.term = c.term JOIN inv v ON v.server_id = c.server_id AND v.term = c.term AND v.size = 1
      JOIN {sizes} s ON s.server_id = c.server_id AND s.{key} = c.{key} JOIN tot t ON t.server_id = c.server_id WHERE c.uses >= 3 {gate}))
  QUALIFY place <= 8
)"""


def smoothed(rows: str, of: str, name: str) -> str:
    """CTE ``{name}``: ``rows`` (server_id, ``of``, day, value) with smooth, share and day_rank."""
    return f"""
{name} AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY server_id, day ORDER BY round(share, 9) DESC, {of})::INT AS day_rank FROM (
    SELECT *, CASE WHEN whole > 0 THEN smooth / whole ELSE 0.0 END AS share FROM (
      SELECT *, sum(smooth) OVER (PARTITION BY server_id, day) AS whole FROM (
        SELECT *, (coalesce(value, 0) * 0.58 + coalesce(lag(value, 1) OVER w, 0) * 0.29 + coalesce(lag(value, 2) OVER w, 0) * 0.13)
          / CASE row_number() OVER w WHEN 1 THEN 0.58 WHEN 2 THEN 0.58 + 0.29 ELSE 0.58 + 0.29 + 0.13 END AS smooth
        FROM {rows} WINDOW w AS (PARTITION BY server_id, {of} ORDER BY day))))
)"""


GRAPH = CHAIN + f""",{communities("pruned", S.topic_resolution, "tcom")},{worth("tcom", S.topic_resolution)},
fam AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY server_id, community ORDER BY score DESC, term)::INT AS rank FROM (
    SELECT *, count(*) OVER f AS n, count(*) FILTER (WHERE kind = 'bigram') OVER f AS pairs FROM (
      SELECT node.*, coalesce(c.community, node.term) AS community, round(ln(1 + uses) * ln(1 + voices) * (1 + least(8.0, greatest(0.0, {log2("greatest(1.0, lift)")}))) * (1 + coalesce(d.degree, 0)), 9) AS score
      FROM node LEFT JOIN tcom c ON c.server_id = node.server_id AND c.term = node.term LEFT JOIN tcom_deg d ON d.server_id = node.server_id AND d.term = node.term WHERE c.community IS NOT NULL OR kind = 'bigram')
    WINDOW f AS (PARTITION BY server_id, community))
  WHERE n >= 2 OR pairs > 0
),
topic AS MATERIALIZED (
  SELECT server_id, community, trim(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '-') AS topic, label, voices, mentions, row_number() OVER (PARTITION BY server_id ORDER BY round(mentions * ln(1 + voices), 9) DESC, label)::INT AS place FROM (
    SELECT f.server_id, f.community, coalesce(arg_min(term, rank) FILTER (WHERE kind = 'bigram'), string_agg(term, ' · ' ORDER BY rank) FILTER (WHERE rank <= 3)) AS label, sum(uses)::BIGINT AS mentions, any_value(v.voices) AS voices
    FROM fam f JOIN (SELECT f.server_id, f.community, count(DISTINCT speaker) AS voices FROM cfact c JOIN fam f ON f.server_id = c.server_id AND f.term = c.term AND f.kind = c.kind GROUP BY 1, 2) v ON v.server_id = f.server_id AND v.community = f.community GROUP BY 1, 2)
  QUALIFY place <= {S.topics}
),
bword AS (SELECT DISTINCT t.server_id, t.topic, unnest(string_split(f.term, ' ')) AS word FROM fam f JOIN topic t ON t.server_id = f.server_id AND t.community = f.community WHERE kind = 'bigram'),
inside AS MATERIALIZED (
  SELECT DISTINCT b.server_id, b.topic, coalesce(c.canonical, b.word) AS term FROM bword b LEFT JOIN (
    SELECT server_id, word, arg_min(c, k) AS canonical FROM (SELECT server_id, word, unnest({fold("word")}) AS c, unnest([1, 2, 3]) AS k FROM (SELECT DISTINCT server_id, word FROM bword))
    JOIN (SELECT server_id, term AS c FROM inv WHERE size = 1) USING (server_id, c) GROUP BY 1, 2) c ON c.server_id = b.server_id AND c.word = b.word
),
member AS MATERIALIZED (
  SELECT f.server_id, t.topic, t.label, f.term, f.kind, f.uses, f.voices, round(f.lift, 1) AS lift, f.rank, i.term IS NULL AS label_visible
  FROM fam f JOIN topic t ON t.server_id = f.server_id AND t.community = f.community LEFT JOIN inside i ON i.server_id = f.server_id AND i.topic = t.topic AND i.term = f.term AND f.kind = 'word'
),
shown AS MATERIALIZED (SELECT * FROM member WHERE rank <= {S.topic_units}),
tday AS MATERIALIZED (
  SELECT x.server_id, x.topic, a.day, round(coalesce(uses, 0) / greatest(a.tokens, 1) * 10000, 3) AS value FROM (SELECT DISTINCT server_id, topic FROM member) x JOIN act a ON a.server_id = x.server_id
  LEFT JOIN (SELECT c.server_id, m.topic, c.day, sum(c.uses) AS uses FROM cfact c JOIN member m ON m.server_id = c.server_id AND m.term = c.term AND m.kind = c.kind GROUP BY 1, 2, 3) u ON u.server_id = x.server_id AND u.topic = x.topic AND u.day = a.day
),{smoothed("tday", "topic", "tshare")},
uday AS MATERIALIZED (
  SELECT x.server_id, x.topic, a.day, round(coalesce(uses, 0) / greatest(a.tokens, 1) * 10000, 3) AS smooth FROM (SELECT DISTINCT server_id, kind || '|' || term AS topic FROM shown) x JOIN act a ON a.server_id = x.server_id
  LEFT JOIN (SELECT c.server_id, c.kind || '|' || c.term AS topic, c.day, sum(c.uses) AS uses FROM cfact c JOIN shown m ON m.server_id = c.server_id AND m.term = c.term AND m.kind = c.kind GROUP BY 1, 2, 3) u ON u.server_id = x.server_id AND u.topic = x.topic AND u.day = a.day
),
seen AS MATERIALIZED (SELECT DISTINCT server_id, term FROM shown),
between AS MATERIALIZED (SELECT e.* FROM edge e JOIN seen a ON a.server_id = e.server_id AND a.term = e.l JOIN seen b ON b.server_id = e.server_id AND b.term = e.r),
vis AS MATERIALIZED (SELECT server_id, l, r, round(weight / max(weight) OVER (PARTITION BY server_id), 4) AS weight, documents, relation FROM ({strongest("between", S.visible_links)})),
allowed AS MATERIALIZED (SELECT server_id, term FROM lex UNION SELECT server_id, term FROM shown WHERE kind = 'word'),
paff AS MATERIALIZED ({strongest("aff", S.person_links)}),{communities("paff", S.circle_resolution, "pcom")},{worth("pcom", S.circle_resolution)},
circ AS MATERIALIZED (
  SELECT g.server_id, g.circle, c.term AS speaker, p.name, p.messages FROM pcom c JOIN ppl p ON p.server_id = c.server_id AND p.speaker = c.term JOIN (
    SELECT server_id, community, row_number() OVER (PARTITION BY server_id ORDER BY m DESC, community)::INT AS circle FROM (
      SELECT c.server_id, community, count(*) AS n, sum(messages) AS m FROM pcom c JOIN ppl p ON p.server_id = c.server_id AND p.speaker = c.term GROUP BY 1, 2) WHERE n >= 2 QUALIFY circle <= 6) g
  ON g.server_id = c.server_id AND g.community = c.community
),
croom AS MATERIALIZED (
  SELECT server_id, circle, row_number() OVER (PARTITION BY server_id, circle ORDER BY score DESC, channel)::INT AS place, channel, messages FROM (
    SELECT p.server_id, circle, p.channel, sum(p.messages)::BIGINT AS messages, round(sum(p.messages) * sum(p.messages) / greatest(any_value(w.every), 1), 9) AS score
    FROM part p JOIN circ c ON c.server_id = p.server_id AND c.speaker = p.speaker JOIN (SELECT server_id, channel, sum(messages) AS every FROM part GROUP BY 1, 2) w ON w.server_id = p.server_id AND w.channel = p.channel GROUP BY 1, 2, 3)
  QUALIFY place <= 5
),
cfc AS (SELECT c.server_id, g.circle, c.term, c.kind, sum(c.uses) AS uses FROM cfact c JOIN circ g ON g.server_id = c.server_id AND g.speaker = c.speaker GROUP BY ALL),{mix("circle", "cfc", "cmix")},{mix("channel", "cfact", "rmix")},{mix("speaker", "cfact", "pmix")},
clabel AS MATERIALIZED (
  SELECT r.server_id, r.circle, '#' || r.channel || ' · ' || coalesce(string_split(t.topic, ' · ')[1], 'conversation') AS label FROM croom r LEFT JOIN (
    SELECT server_id, circle, arg_max(label, (round(ln(1 + mentions) * (1 + greatest(0.0, {log2("greatest(lift, 1e-9)")})), 9), label)) AS topic FROM cmix WHERE place <= 5 GROUP BY 1, 2) t ON t.server_id = r.server_id AND t.circle = r.circle WHERE r.place = 1
),
cword AS (
  SELECT w.server_id, g.circle, w.term, sum(w.uses)::BIGINT AS uses, count(*) AS voices, any_value(n.members) AS members FROM (SELECT server_id, speaker, term, sum(uses) AS uses FROM fact WHERE is_current AND size = 1 GROUP BY 1, 2, 3) w
  JOIN circ g ON g.server_id = w.server_id AND g.speaker = w.speaker JOIN (SELECT server_id, circle, count(*) AS members FROM circ GROUP BY 1, 2) n ON n.server_id = g.server_id AND n.circle = g.circle GROUP BY 1, 2, 3
),
csize AS (SELECT g.server_id, g.circle, sum(p.tokens) AS size FROM circ g JOIN ppl p ON p.server_id = g.server_id AND p.speaker = g.speaker GROUP BY 1, 2),{distinctive("circle", "cword", "csize", True, "clang")},
rword AS (SELECT server_id, channel, term, sum(uses)::BIGINT AS uses FROM fact WHERE is_current AND size = 1 GROUP BY 1, 2, 3),
rsize AS (SELECT server_id, channel, sum(n_tokens) AS size FROM tok WHERE is_current GROUP BY 1, 2),{distinctive("channel", "rword", "rsize", False, "rlang")},
proom AS (SELECT server_id, speaker, channel, messages, row_number() OVER (PARTITION BY server_id, speaker ORDER BY messages DESC, first, channel) AS k FROM part QUALIFY k <= 5),
said AS (
  SELECT f.server_id, f.speaker, f.size, f.term, sum(f.uses)::BIGINT AS uses FROM fact f JOIN (SELECT server_id, 1 AS size, term FROM lex UNION ALL SELECT server_id, size, term FROM phr) s
  ON s.server_id = f.server_id AND s.size = f.size AND s.term = f.term WHERE is_current GROUP BY ALL
),
room AS MATERIALIZED (
  SELECT server_id, channel, messages, voices, place FROM (
    SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY messages DESC, first, channel)::INT AS place FROM (SELECT server_id, channel, sum(messages)::BIGINT AS messages, count(*) AS voices, min(first) AS first FROM part GROUP BY 1, 2)) WHERE place <= 10
),
roomp AS (
  SELECT r.server_id, r.channel, p.name, a.messages, row_number() OVER (PARTITION BY r.server_id, r.channel ORDER BY a.messages DESC, p.name, a.speaker) AS k
  FROM room r JOIN part a ON a.server_id = r.server_id AND a.channel = r.channel JOIN ppl p ON p.server_id = a.server_id AND p.speaker = a.speaker QUALIFY k <= 6
),
dirn AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY server_id, direction ORDER BY abs(momentum) DESC, CASE WHEN direction = 'rising' THEN recent_rate ELSE previous_rate END DESC, term)::INT AS place FROM (
    SELECT *, CASE WHEN recent_rate >= 0.3 AND momentum > 0.35 THEN 'rising' WHEN previous_rate >= 0.3 AND momentum < -0.35 THEN 'fading' END AS direction FROM (SELECT {MOVE} FROM cand)) WHERE direction IS NOT NULL
),
dword AS MATERIALIZED (SELECT server_id, direction, place, unnest(string_split(term, ' ')) AS word, generate_subscripts(string_split(term, ' '), 1) AS spot FROM dirn),
dfold AS MATERIALIZED (
  SELECT server_id, word, arg_min(c, k) AS canonical FROM (SELECT server_id, word, unnest({fold("word")}) AS c, unnest([1, 2, 3]) AS k FROM (SELECT DISTINCT server_id, word FROM dword))
  JOIN (SELECT server_id, term AS c FROM hist WHERE size = 1) USING (server_id, c) GROUP BY 1, 2
),
drow AS MATERIALIZED (
  SELECT server_id, direction, list({{'place': place, 'sig': sig}} ORDER BY place) AS rows, count(*) AS n FROM (
    SELECT w.server_id, w.direction, w.place, list(coalesce(f.canonical, w.word) ORDER BY spot) AS sig FROM dword w LEFT JOIN dfold f ON f.server_id = w.server_id AND f.word = w.word GROUP BY 1, 2, 3) GROUP BY 1, 2
),
dstep AS (
  SELECT server_id, direction, 0 AS i, rows[:0] AS kept FROM drow
  UNION ALL
  SELECT server_id, direction, i + 1, CASE WHEN hit IS NULL THEN list_append(kept, new) WHEN len(kept[hit].sig) = 1 AND len(new.sig) > 1 THEN list_transform(kept, lambda x, j: CASE WHEN j = hit THEN new ELSE x END) ELSE kept END
  FROM (
    SELECT *, list_min(list_filter(range(1, len(kept) + 1), lambda j: kept[j].sig = new.sig OR (len(new.sig) = 1 AND list_contains(kept[j].sig, new.sig[1])) OR (len(kept[j].sig) = 1 AND list_contains(new.sig, kept[j].sig[1])))) AS hit
    FROM (SELECT s.*, d.rows[i + 1] AS new FROM dstep s JOIN drow d ON d.server_id = s.server_id AND d.direction = s.direction WHERE s.i < d.n AND len(s.kept) < 16))
),
div AS MATERIALIZED (
  SELECT d.* EXCLUDE (place), k.slot::INT AS place FROM dirn d JOIN (
    SELECT server_id, direction, unnest(kept).place AS place, generate_subscripts(kept, 1) AS slot FROM (SELECT server_id, direction, arg_max(kept, i) AS kept FROM dstep GROUP BY 1, 2)) k
  ON k.server_id = d.server_id AND k.direction = d.direction AND k.place = d.place
),
dom AS MATERIALIZED (
  SELECT server_id, domain, uses, voices, active_days, place FROM (
    SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY uses DESC, first, domain)::INT AS place FROM (
      SELECT server_id, domain, count(*) AS uses, count(DISTINCT speaker) AS voices, count(DISTINCT day) AS active_days, min((ts, spot)) AS first FROM (
        SELECT * EXCLUDE (domain), CASE domain WHEN 'twitter.com' THEN 'x.com' WHEN 'mobile.twitter.com' THEN 'x.com' WHEN 'youtu.be' THEN 'youtube.com' WHEN 'm.youtube.com' THEN 'youtube.com' ELSE domain END AS domain FROM (
          SELECT *, regexp_replace(lower(regexp_extract(rtrim(link, '.,;:!?)]}}'), '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '') AS domain FROM (
            SELECT server_id, speaker, day, ts, unnest(regexp_extract_all(message, '(?i)https?://[^\\s<>]+')) AS link, generate_subscripts(regexp_extract_all(message, '(?i)https?://[^\\s<>]+'), 1) - 1 AS spot FROM elig WHERE is_current)))
      WHERE domain <> '' GROUP BY 1, 2)) WHERE place <= 20
)
"""
