"""DuckDB statements equal to the queries of this package, where SQL can state them."""

from __future__ import annotations

_SIDE = "lower(trim(coalesce(line_type, ''), ' \t\n\r')) IN ('summary', 'attachment', 'system', 'tool_result')"
_SPEAKER = """CASE WHEN lower(trim(coalesce(message.role, line_type), ' \t\n\r')) IN ('user', 'human') THEN 'user'
 WHEN lower(trim(coalesce(message.role, line_type), ' \t\n\r')) IN ('assistant', 'ai', 'model') THEN 'assistant' END"""
_SAID = r"regexp_matches(coalesce(message.content, ''), '[^\s\p{Z}\x{85}]')"

ORACLES: dict[str, str] = {}

ORACLES["p1_found"] = f"""
WITH r AS (SELECT lower(trim(session_id, ' \t\n\r')) AS s, ts, min(line_id) AS line_id FROM capture_lines
           WHERE ts IS NOT NULL AND session_id IS NOT NULL AND message IS NOT NULL AND NOT ({_SIDE}) AND ({_SPEAKER}) = 'user' AND {_SAID} GROUP BY 1, 2),
     l AS (SELECT journal_id, lower(trim(session_id, ' \t\n\r')) AS s, ts FROM journal WHERE ts IS NOT NULL AND session_id IS NOT NULL),
     c AS (SELECT journal_id, line_id, row_number() OVER (PARTITION BY journal_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), line_id) AS rn
           FROM l JOIN r ON l.s = r.s AND r.ts BETWEEN l.ts - INTERVAL 15 SECOND AND l.ts + INTERVAL 15 SECOND)
SELECT journal_id, line_id FROM c WHERE rn = 1"""

_TURNS = f"""
WITH c AS (SELECT *, {_SIDE} AS side, CASE WHEN message IS NOT NULL THEN {_SPEAKER} END AS speaker, {_SAID} AS said FROM capture_lines),
     g AS (SELECT *, max(CASE WHEN ts IS NOT NULL THEN struct_pack(line := line, ts := ts) END)
             OVER (PARTITION BY path ORDER BY line RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM c),
     f AS (SELECT *, coalesce(ts, near.ts) AS t FROM g WHERE NOT side AND conv_id IS NOT NULL),
     k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, speaker, ts, message.content ORDER BY line_id) AS copy FROM f),
     u AS (SELECT *, speaker IS NOT NULL AND said AND (ts IS NULL OR copy = 1) AS turn FROM k),
     o AS (SELECT conv_id, line_id, speaker, row_number() OVER w AS turn_no, lead(speaker) OVER w AS after
           FROM u WHERE turn WINDOW w AS (PARTITION BY conv_id ORDER BY t NULLS FIRST, line NULLS FIRST, line_id)),
     v AS (SELECT conv_id, max(speaker IS NULL) AS broken, count(*) AS lines, count(*) FILTER (turn) AS turns FROM u GROUP BY 1),
     a AS (SELECT conv_id, max(speaker) FILTER (turn_no = 1) AS opened, bool_or(speaker = 'user' AND coalesce(after, '') <> 'assistant') AS open FROM o GROUP BY 1),
     z AS (SELECT v.conv_id, turns, lines, CASE WHEN broken THEN 'broken' WHEN turns = 0 THEN 'empty' WHEN opened <> 'user' THEN 'no question'
             WHEN open THEN 'no reply' ELSE 'kept' END AS verdict FROM v LEFT JOIN a USING (conv_id))
"""
ORACLES["p3_found"] = _TURNS + "SELECT conv_id, turn_no, line_id FROM o SEMI JOIN (SELECT conv_id FROM z WHERE verdict = 'kept') USING (conv_id)"
ORACLES["p3_verdicts"] = _TURNS + "SELECT conv_id, verdict, turns::BIGINT AS turns, lines::BIGINT AS lines FROM z"

_WORDS = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+')".replace("\\\\", "\\")
_SPACED = r"list_filter(regexp_split_to_array(text, '[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]+'), lambda x: x <> '')"

ORACLES["p4_found"] = f"""
WITH b AS (SELECT id, arg_min(concat_ws(' ', title, text, learning), seq) AS body FROM world_log
           WHERE replaces_id IS NULL AND retires_id IS NULL AND id IS NOT NULL GROUP BY id),
     w AS (SELECT id, {_WORDS.format('body')} AS w FROM b),
     s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 12)),
     n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
     o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM o JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9"""

ORACLES["p8_found"] = f"""
WITH i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM eval_items WHERE text IS NOT NULL),
     d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
     ig AS (SELECT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i)),
     dg AS (SELECT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""

ORACLES["p10_found"] = f"""
WITH d AS (SELECT doc_id, {_SPACED} AS w FROM documents WHERE text IS NOT NULL),
     r AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], chr(1))) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d)),
     t AS (SELECT g FROM r GROUP BY g HAVING min(doc_id) <> max(doc_id)),
     s AS (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS nx FROM r SEMI JOIN t USING (g))
SELECT doc_id, sum(least(50, coalesce(nx - k, 50)))::BIGINT AS shared_words FROM s GROUP BY doc_id"""
