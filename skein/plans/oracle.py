"""The library's queries as SQL for DuckDB, over views named like the tables.

RE2 has no look-around, its \\b is ASCII like the patterns' own, and its \\s is wider or narrower
than JavaScript's, so blanks are spelled out.
"""

from __future__ import annotations

from skein.functions import jstext

WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"
HAN = r"\x{4E00}-\x{9FFF}"


def q(text: str) -> str:
    """A SQL string."""
    return "'" + text.replace("'", "''") + "'"


def re2(js: str) -> str:
    """A JavaScript pattern for RE2."""
    return js.replace(r"\S", f"[^{WS}]").replace(r"\s", f"[{WS}]")


def sub(text: str, js: str, new: str) -> str:
    return f"regexp_replace({text}, {q(re2(js))}, {q(new)}, 'g')"


def count(text: str, js: str) -> str:
    return f"coalesce(len(regexp_extract_all({text}, {q(re2(js))})), 0)"


def trim(text: str) -> str:
    return sub(text, r"^\s+|\s+$", "")


def denoised(text: str) -> str:
    for js, name in jstext.NOISE:
        text = f"regexp_replace({text}, {q(re2(js).replace(f'[[{WS}][^{WS}]]', '(?s:.)'))}, {q(name)}, 'g')"
    line = f"CASE WHEN length(l) >= {jstext.LONG_LINE} THEN substring(l, 1, {jstext.KEPT}) || '... [truncated ' || length(l) || ' chars]' ELSE l END"
    return f"regexp_replace(array_to_string(list_transform(string_split({text}, chr(10)), lambda l: {line}), chr(10)), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')"


def specificity(text: str) -> str:
    """Details of a text. RE2 has no \\B before a look-ahead difference here: it is ASCII too."""
    return "(" + " + ".join(count(f"coalesce({text}, '')", p) for p in jstext.SPECIFIC) + ")"


def vague(content: str, impact: str, detail: str = "details", more: str = "impact_details") -> str:
    phrases = " OR ".join(f"contains(lower({content}), {q(p)})" for p in jstext.VAGUE_ZH + jstext.VAGUE_EN)
    return f"coalesce({detail} = 0 AND (({phrases}) OR length({content}) < 80 OR (length({content}) < 200 AND {more} = 0)), false)"


def bare(text: str) -> str:
    return f"regexp_replace(lower({text}), '[^A-Za-z0-9_{HAN}]', '', 'g')"


QUALITY = f"""
d AS (SELECT *, {specificity('content')} AS details, {specificity('impact')} AS impact_details, {bare('title')} AS bt, {bare('content')} AS bc FROM memories),
e AS (SELECT *, CASE WHEN length(bt) <= length(bc) THEN bt ELSE bc END AS s, CASE WHEN length(bt) <= length(bc) THEN bc ELSE bt END AS l, {vague('content', 'impact')} AS v FROM d),
f AS (SELECT *, CASE WHEN bt = '' OR bc = '' THEN 0 WHEN bt = bc THEN 1 WHEN contains(l, s) AND length(bt) <= length(bc) AND length(s) / length(l) > 0.7 THEN 1 WHEN contains(l, s) AND length(s) / length(l) > 0.8 THEN 0.9 ELSE 0 END AS likeness FROM e),
g AS (SELECT *, CASE WHEN coalesce(length(content), 0) < 30 THEN 'short' WHEN likeness > 0.8 THEN 'duplicate' WHEN v THEN 'vague' END AS reason FROM f)
"""

EN = ", ".join(q(w) for w in jstext.STOPWORDS_EN)
ZH = ", ".join(q(w) for w in jstext.STOPWORDS_CJK)


def keywords(text: str) -> str:
    lower = f"lower(coalesce({text}, ''))"
    latin = f"list_filter(regexp_split_to_array(regexp_replace({lower}, '[{CJK}]', ' ', 'g'), '[{WS}]+'), lambda w: length(w) >= 2 AND w NOT IN ({EN}))"

    def grams(n: int) -> str:
        return f"list_transform(range(1, greatest(length(r) - {n - 1} + 1, 1)), lambda i: substring(r, i, {n}))"

    runs = f"regexp_extract_all({lower}, '[{CJK}]+')"
    each = f"list_transform({runs}, lambda r: list_concat(list_concat(list_filter({grams(1)}, lambda g: g NOT IN ({ZH})), list_filter({grams(2)}, lambda g: g NOT IN ({ZH}))), {grams(3)}))"
    return f"list_distinct(list_concat({latin}, flatten({each})))"


def shingles(text: str) -> str:
    flat = f"trim(regexp_replace(lower(coalesce({text}, '')), '[{WS}]+', ' ', 'g'), ' ')"
    return f"(SELECT list_sort(list_distinct(list_transform(range(1, greatest(length(s) - 1, 1)), lambda i: substring(s, i, 3)))) FROM (SELECT {flat} AS s))"


def slug(text: str) -> str:
    kept = f"regexp_replace(lower({text}), '[^A-Za-z0-9_{HAN}\\-{WS}]', '', 'g')"
    joined = f"regexp_replace(regexp_replace({trim(kept)}, '[{WS}]+', '-', 'g'), '-+', '-', 'g')"
    cut = f"regexp_replace(substring({joined}, 1, 60), '-$', '')"
    return f"coalesce(nullif({cut}, ''), 'untitled')"


def author_slug(text: str) -> str:
    kept = f"regexp_replace(lower({trim(text)}), '[^A-Za-z0-9_{HAN}\\-{WS}]', '', 'g')"
    joined = f"regexp_replace(regexp_replace({kept}, '[{WS}]+', '-', 'g'), '-+', '-', 'g')"
    return f"substring(regexp_replace({joined}, '^-+|-+$', '', 'g'), 1, 40)"


ID = "substring(sha256(coalesce(mem_type, '') || ':' || coalesce(title, '') || ':' || coalesce(mem_date, '')), 1, 16)"
BACKUP = "coalesce(starts_with(file_path, 'backup/'), false)"
ARRIVED = f"(coalesce(mem_date, '') >= '2025' OR {BACKUP})"
ACTIVE = "coalesce(status, 'active') <> 'resolved'"
SOUND = "vector IS NOT NULL AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
SETS = f"sets AS (SELECT mem_type AS grp, mem_no AS id, {shingles('content')} AS grams FROM memories), cls AS (SELECT grp, grams, min(id) AS rep, count(*) AS copies FROM sets WHERE len(grams) > 0 GROUP BY grp, grams)"


def score(words: list[str]) -> str:
    terms = []
    for w in words:
        bonus = 2.0 if len(w) >= 3 else 1.2 if len(w) == 2 else 1.0
        terms += [f"CASE WHEN contains(lower(coalesce({f}, '')), {q(w)}) THEN {x * bonus}::DOUBLE ELSE 0::DOUBLE END" for f, x in jstext.FIELD_WEIGHTS.items()]
        terms.append(f"CASE WHEN contains(lower(coalesce(mem_type, '')), {q(w)}) THEN {jstext.TYPE_WEIGHT}::DOUBLE ELSE 0::DOUBLE END")
    return " + ".join(terms)


RECENT = "CASE WHEN NOT coalesce(regexp_full_match(mem_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), false) OR TRY_CAST(mem_date AS DATE) IS NULL THEN 0::DOUBLE WHEN DATE '2026-07-01' < TRY_CAST(mem_date AS DATE) THEN 1::DOUBLE ELSE exp(-date_diff('day', TRY_CAST(mem_date AS DATE), DATE '2026-07-01') / 90.0::DOUBLE) END"
# The words of library.QUERY.
WORDS = ["retry", "budget", "session", "cache"]
RANKED = f"k AS (SELECT *, {score(WORDS)} AS kw, {RECENT} AS recency, {ID} AS mid FROM memories WHERE {ACTIVE})"
VECTORS = f"v AS (SELECT id, min(vector) AS vector FROM vector_entries WHERE {SOUND} GROUP BY id), qv AS (SELECT arg_min(vector, id) AS q FROM vector_entries WHERE {SOUND} AND len(vector) = 64 AND dimension = 64)"
COSINE = "CASE WHEN len(vector) = len(q) AND list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) > 0 THEN list_dot_product(vector::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))) ELSE 0::DOUBLE END"


def bag(parts: list[tuple[str, str, int]], source: str, key: str) -> str:
    rows = " UNION ALL ".join(f"SELECT {key} AS id, unnest({keywords(f)}) AS token, {w} AS w FROM {s}" for s, f, w in ((s or source, f, w) for s, f, w in parts))
    return f"SELECT id, token, sum(w) AS w FROM ({rows}) GROUP BY id, token"


MEM_BAG = bag([("", "title", 3), ("", "mem_type", 2), ("", "substring(content, 1, 500)", 1)], f"(SELECT * FROM memories WHERE {ACTIVE})", "mem_no")
COM_BAG = bag([("", "subject", 3), ("(SELECT commit_no, regexp_replace(unnest(paths), '[/\\\\._-]', ' ', 'g') AS p FROM commits)", "p", 2), ("", "substring(body, 1, 500)", 1), ("", "author", 1)], "commits", "commit_no")
PATHS = f"""SELECT mem_no, content, coalesce(nullif({author_slug('author')}, ''), 'unknown') || '/' ||
  CASE mem_type WHEN 'decision' THEN 'decisions' WHEN 'architecture' THEN 'architecture' WHEN 'convention' THEN 'conventions' WHEN 'todo' THEN 'todos' WHEN 'issue' THEN 'issues' ELSE 'other' END || '/' ||
  coalesce(mem_date, '') || '-' || {slug('title')} || '.md' AS path, {ARRIVED} AS fresh FROM memories"""
KEY = f"coalesce(author, '') || '|' || coalesce(mem_type, '') || '|' || coalesce(mem_date, '') || '|' || lower({trim(chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')})"


def redact(rules: list[tuple[str, str]]) -> tuple[str, dict[str, str]]:
    text, hits = "text", {}
    for name, js in rules:
        hits[name] = count(text, js)
        text = f"regexp_replace({text}, {q(re2(js))}, {q((chr(92) + '1' if name == 'internal-hostname' else '') + f'<REDACTED:{name}>')}, 'g')"
    return text, hits


def staged(rules: list[tuple[str, str]]) -> str:
    """Redaction as one subquery per rule, each over the text that the one before left."""
    inner, hits = "SELECT msg_id, text AS t FROM chat_messages WHERE text IS NOT NULL", []
    for i, (name, js) in enumerate(rules):
        new = q((chr(92) + "1" if name == "internal-hostname" else "") + f"<REDACTED:{name}>")
        carried = "".join(f", h{j}, c{j}" for j in range(i))
        group = 2 if name == "internal-hostname" else 0
        chars = f"coalesce(list_sum(list_transform(regexp_extract_all(t, {q(re2(js))}, {group}), lambda x: length(x))), 0)"
        inner = f"SELECT msg_id, regexp_replace(t, {q(re2(js))}, {new}, 'g') AS t{carried}, {count('t', js)} AS h{i}, {chars} AS c{i} FROM ({inner})"
        hits.append(f"h{i}")
    return inner


def has(words: str, *columns: str) -> str:
    """Whether one of the columns contains the words, in any case."""
    return "(" + " OR ".join(f"coalesce(contains(lower({c}), {q(words)}), false)" for c in columns) + ")"


def last_of(text: str, word: str) -> str:
    """The 0-based place of the last occurrence of a word, -1 for none."""
    return f"CASE WHEN contains({text}, {word}) THEN length({text}) - strpos(reverse({text}), reverse({word})) - length({word}) + 1 ELSE -1 END"


USER, ASSISTANT = "(chr(10) || chr(10) || 'User:')", "(chr(10) || chr(10) || 'Assistant:')"
CHUNKS = f"""WITH RECURSIVE w AS (SELECT doc_id, text, 0::BIGINT AS start FROM documents WHERE length(text) > 20000 UNION ALL SELECT doc_id, text, nxt FROM
            (SELECT doc_id, text, start + greatest((CASE WHEN start + 20000 < length(text) THEN CASE WHEN sp > 10000 THEN sp ELSE 20000 END ELSE 20000 END) - 2000, 1000) AS nxt FROM
             (SELECT *, greatest({last_of('x', USER)}, {last_of('x', ASSISTANT)}) AS sp FROM (SELECT *, substring(text, start + 1, 20000) AS x FROM w))) WHERE nxt < length(text)),
          s AS (SELECT *, greatest({last_of('x', USER)}, {last_of('x', ASSISTANT)}) AS sp FROM (SELECT *, substring(text, start + 1, 20000) AS x FROM w)),
          c AS (SELECT doc_id, start, {trim('substring(x, 1, CASE WHEN start + 20000 < length(text) AND sp > 10000 THEN sp ELSE 20000 END)')} AS t FROM s)
          SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS chunk, length(t)::INT AS n_chars, md5(t) AS digest FROM c WHERE length(t) > 100
          UNION ALL SELECT doc_id, 0, length(text)::INT, md5(text) FROM documents WHERE length(text) <= 20000"""


def build(rules: list[tuple[str, str]]) -> dict[str, str]:
    """The SQL of every query; rules are the redaction rules."""
    chain, n = staged(rules), len(rules)
    noisy = denoised("t")
    edges = f"""WITH w AS (SELECT DISTINCT mem_no, source_id, unnest(list_filter(regexp_split_to_array(lower(title), '[{WS}\\-_/]+'), lambda x: length(x) > 3)) AS word FROM memories WHERE title IS NOT NULL),
          r AS (SELECT word FROM w GROUP BY word HAVING count(*) BETWEEN 2 AND 8) SELECT DISTINCT x.mem_no AS a, y.mem_no AS b FROM w x JOIN w y ON x.word = y.word AND x.mem_no < y.mem_no
          WHERE x.word IN (SELECT word FROM r) AND NOT coalesce(nullif(x.source_id, '') = nullif(y.source_id, ''), false)"""
    return {
        "proj05_conversation_text": f"""WITH r AS (SELECT conv_id, role, {trim('text')} AS t FROM chat_messages WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND conv_id IS NOT NULL),
          s AS (SELECT conv_id, length({noisy}) + CASE WHEN role = 'user' THEN 6 ELSE 11 END AS size FROM r WHERE t <> '' AND NOT (role = 'assistant' AND length(t) < 30)),
          g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, (sum(size) + 2 * (count(*) - 1))::BIGINT AS n_chars FROM s GROUP BY conv_id)
          SELECT conv_id, n_turns, n_chars, ceil(n_chars / 4)::BIGINT AS approx_tokens FROM g""",
        "t01_cleaned": f"SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM (SELECT doc_id, {denoised('text')} AS t FROM documents WHERE text IS NOT NULL)",
        "t02_chunks": CHUNKS,
        "t05_redacted": f"SELECT msg_id, ({' + '.join(f'h{i}' for i in range(n))})::BIGINT AS hits, md5(t) AS digest FROM ({chain})",
        "a08_redaction_hits": " UNION ALL ".join(f"SELECT {q(name)} AS rule, coalesce(sum(h{i}), 0)::BIGINT AS hits FROM c" for i, (name, _) in enumerate(rules)).join([f"WITH c AS ({chain}) ", ""]),
        "t05_chars": f"WITH c AS ({chain}) SELECT * FROM (" + " UNION ALL ".join(f"SELECT {q(name)} AS rule, coalesce(sum(c{i}), 0)::BIGINT AS chars FROM c" for i, (name, _) in enumerate(rules)) + ") WHERE chars > 0",
        "t07_trails": f"SELECT msg_id, '[redacted: ' || concat_ws(', ', " + ", ".join(f"CASE WHEN h{i} > 0 THEN h{i} || {q(' ' + name)} END" for i, (name, _) in enumerate(rules)) + f") || ']' AS trail FROM ({chain}) WHERE {' + '.join(f'h{i}' for i in range(n))} > 0",
        "k05_titles": f"""SELECT mem_no, regexp_replace(regexp_replace(lower(title), '^(?:{jstext.TITLE_VERBS})[{WS}]+', ''), '[^A-Za-z0-9_{HAN}]', '', 'g') AS normal, {slug('title')} AS slug, {ID} AS id,
          substring(regexp_replace(coalesce(mem_type, '') || ':' || coalesce(mem_date, '') || ':' || coalesce(title, ''), '[^a-zA-Z0-9:{HAN}\\-]', '_', 'g'), 1, 120) AS node FROM memories WHERE title IS NOT NULL""",
        "proj02_embed_texts": """SELECT mem_no, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM (SELECT mem_no, substring(concat_ws(chr(10), '[' || coalesce(mem_type, '') || '] ' || coalesce(title, ''), coalesce(content, ''),
          nullif(context, ''), nullif(reasoning, ''), nullif(impact, '')), 1, 8000) AS t FROM memories)""",
        "d11_quality": f"WITH {QUALITY} SELECT mem_no, details::BIGINT AS details, v AS vague, reason FROM g",
        "a06_quality_counts": f"WITH {QUALITY} SELECT coalesce(reason, 'kept') AS stage, count(*)::BIGINT AS n FROM g GROUP BY 1",
        "r01_keywords": f"SELECT mem_no, array_to_string(list_sort({keywords('concat_ws(chr(32), title, content)')}), '|') AS words FROM memories",
        "r06_keyword_search": f"""WITH {RANKED}, m AS (SELECT max(kw) AS top FROM k), s AS (SELECT mem_no, CASE WHEN top > 0 THEN kw / top ELSE 0 END AS keyword, recency, kw FROM k, m)
          SELECT mem_no, round(0.85::DOUBLE * keyword + 0.15::DOUBLE * recency, 6) AS score, round(keyword, 6) AS keyword, round(recency, 6) AS recency FROM s WHERE kw > 0 ORDER BY 0.85::DOUBLE * keyword + 0.15::DOUBLE * recency DESC, mem_no LIMIT 20""",
        "r04_vector_search": f"WITH {VECTORS} SELECT id, round({COSINE}, 6) AS similarity FROM v, qv ORDER BY {COSINE} DESC, id LIMIT 10",
        "r05_hybrid_search": f"""WITH {RANKED}, {VECTORS}, n AS (SELECT id, {COSINE} AS similarity FROM v, qv), j AS (SELECT k.*, coalesce(similarity, 0) AS sem FROM k LEFT JOIN n ON n.id = mid),
          m AS (SELECT greatest(max(kw), 0) AS kt, greatest(max(sem), 0) AS st FROM j),
          s AS (SELECT mem_no, kw, recency, st, CASE WHEN kt > 0 THEN kw / kt ELSE 0 END AS keyword, CASE WHEN st > 0 THEN sem / st ELSE 0 END AS semantic FROM j, m),
          t AS (SELECT *, CASE WHEN st > 0 THEN 0.55::DOUBLE * semantic + 0.3::DOUBLE * keyword + 0.15::DOUBLE * recency ELSE 0.85::DOUBLE * keyword + 0.15::DOUBLE * recency END AS total FROM s WHERE kw > 0 OR semantic > 0.3)
          SELECT mem_no, round(total, 6) AS score, round(semantic, 6) AS semantic, round(keyword, 6) AS keyword, round(recency, 6) AS recency FROM t ORDER BY total DESC, mem_no LIMIT 20""",
        "r04_every_vector_search": f"""WITH v AS (SELECT id, min(vector)::DOUBLE[] AS vector FROM vector_entries WHERE id IS NOT NULL AND {SOUND} GROUP BY id),
          p AS (SELECT a.id AS query, b.id AS id, round(list_cosine_similarity(a.vector, b.vector), 10) AS s FROM v a JOIN v b ON len(a.vector) = len(b.vector) AND a.id <> b.id WHERE ('0x' || substring(a.id, 1, 7))::BIGINT % 50 = 0 AND len(list_filter(a.vector, lambda x: x <> 0)) > 0 AND len(list_filter(b.vector, lambda x: x <> 0)) > 0)
          SELECT query, id, round(s, 6) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, id) <= 10""",
        "r06_every_keyword_search": f"""WITH q AS (SELECT mem_no AS query, unnest({keywords('title')}) AS w FROM memories WHERE mem_no % 50 = 0 AND title IS NOT NULL), k AS (SELECT *, {RECENT} AS recency FROM memories WHERE {ACTIVE}),
          p AS (SELECT query, mem_no, any_value(recency) AS recency, sum({' + '.join(f"CASE WHEN contains(lower(coalesce({f}, '')), w) THEN {x}::DOUBLE * CASE WHEN length(w) >= 3 THEN 2 WHEN length(w) = 2 THEN 1.2 ELSE 1 END ELSE 0 END" for f, x in jstext.FIELD_WEIGHTS.items())} + CASE WHEN contains(lower(coalesce(mem_type, '')), w) THEN {jstext.TYPE_WEIGHT}::DOUBLE ELSE 0 END) AS kw FROM q, k GROUP BY 1, 2),
          s AS (SELECT *, kw / max(kw) OVER (PARTITION BY query) AS keyword FROM p WHERE kw > 0), t AS (SELECT *, 0.85::DOUBLE * keyword + 0.15::DOUBLE * recency AS total FROM s)
          SELECT query, mem_no, round(total, 6) AS score, round(keyword, 6) AS keyword FROM t QUALIFY row_number() OVER (PARTITION BY query ORDER BY total DESC, mem_no) <= 20""",
        "j05_similar_records": f"""WITH {SETS}, p AS (SELECT x.grp, x.rep AS a, y.rep AS b, len(x.grams) AS na, len(y.grams) AS nb, len(list_intersect(x.grams, y.grams)) AS s FROM cls x JOIN cls y ON x.grp IS NOT DISTINCT FROM y.grp AND x.rep < y.rep),
          r AS (SELECT *, s / (na + nb - s) AS j, s / least(na, nb) AS c FROM p) SELECT grp, a, b, round(j, 6) AS jaccard, round(c, 6) AS contained FROM r WHERE j > 0.55 OR c > 0.75""",
        "j05_similar_classes": f"WITH {SETS} SELECT id AS mem_no, rep, copies::BIGINT AS copies FROM sets JOIN cls ON sets.grp IS NOT DISTINCT FROM cls.grp AND sets.grams = cls.grams",
        "d05_new_records": f"""WITH s AS (SELECT mem_no, mem_type, {shingles('content')} AS g, {ARRIVED} AS fresh FROM memories), o AS (SELECT DISTINCT mem_type, g FROM s WHERE NOT fresh AND len(g) > 0)
          SELECT mem_no FROM s WHERE fresh AND NOT EXISTS (SELECT 1 FROM o WHERE o.mem_type IS NOT DISTINCT FROM s.mem_type AND len(s.g) > 0 AND
          (len(list_intersect(s.g, o.g)) / (len(s.g) + len(o.g) - len(list_intersect(s.g, o.g))) > 0.55 OR len(list_intersect(s.g, o.g)) / len(s.g) > 0.75))""",
        "d06_todos_left": f"""WITH t AS (SELECT mem_no, source_id, {shingles("concat_ws(' ', title, content)")} AS g FROM memories WHERE mem_type = 'todo' AND NOT {BACKUP}),
          a AS (SELECT source_id, {shingles("concat_ws(' ', title, content, reasoning)")} AS g FROM memories WHERE mem_type IN ('decision', 'architecture', 'convention') OR {BACKUP})
          SELECT mem_no FROM memories WHERE mem_no NOT IN (SELECT t.mem_no FROM t JOIN a ON t.source_id IS NOT DISTINCT FROM a.source_id WHERE len(t.g) > 0 AND len(list_intersect(t.g, a.g)) / len(t.g) > 0.75)""",
        "j04_commit_candidates": f"""WITH m AS ({MEM_BAG}), c AS ({COM_BAG}), wm AS (SELECT id, sum(w) AS w FROM m GROUP BY id), wc AS (SELECT id, sum(w) AS w FROM c GROUP BY id),
          s AS (SELECT m.id AS a, c.id AS b, sum(least(m.w, c.w)) AS low FROM m JOIN c ON m.token = c.token GROUP BY 1, 2),
          r AS (SELECT a, b, low / (wm.w + wc.w - low)::DOUBLE AS score FROM s JOIN wm ON wm.id = a JOIN wc ON wc.id = b)
          SELECT a AS mem_no, b AS commit_no, floor(score * 1000 + 0.5) / 1000 AS score, CASE WHEN score >= 0.7::DOUBLE THEN 'auto' WHEN score >= 0.4::DOUBLE THEN 'suggest' ELSE 'weak' END AS band FROM r WHERE score >= 0.2::DOUBLE""",
        "k01_write_actions": f"WITH p AS ({PATHS}) SELECT CASE WHEN path IN (SELECT path FROM p WHERE NOT fresh) THEN 'skipped' ELSE 'created' END AS action, count(*)::BIGINT AS n FROM p WHERE fresh GROUP BY 1",
        "j03_import_plan": f"WITH k AS (SELECT mem_no, {KEY} AS key, {BACKUP} AS fresh FROM memories) SELECT mem_no, CASE WHEN key IN (SELECT key FROM k WHERE NOT fresh) THEN 'skip' ELSE 'import' END AS import_action FROM k WHERE fresh",
        "j02_index_state": f"""WITH m AS (SELECT DISTINCT {ID} AS id FROM memories), v AS (SELECT DISTINCT id FROM vector_entries WHERE vector IS NOT NULL)
          SELECT id, 'unindexed' AS state FROM m WHERE id NOT IN (SELECT id FROM v) UNION ALL SELECT id, 'stale' AS state FROM v WHERE id NOT IN (SELECT id FROM m)""",
        "a01_overview": """WITH r AS (SELECT 'total' AS metric, 'all' AS key FROM memories UNION ALL SELECT 'status', CASE WHEN status = 'resolved' THEN 'resolved' ELSE 'active' END FROM memories
          UNION ALL SELECT 'type', mem_type FROM memories UNION ALL SELECT 'author', nullif(author, '') FROM memories
          UNION ALL SELECT 'month', CASE WHEN regexp_matches(mem_date, '^[0-9]{4}-[0-9]{2}') THEN substring(mem_date, 1, 7) ELSE 'unknown' END FROM memories) SELECT metric, key, count(*)::BIGINT AS n FROM r WHERE key IS NOT NULL GROUP BY 1, 2""",
        "a02_conversations": """SELECT source_id, coalesce(nullif((array_agg(source_title ORDER BY mem_no))[1], ''), '(untitled)') AS title, (array_agg(source_type ORDER BY mem_no))[1] AS source_type, count(*)::BIGINT AS n, count(DISTINCT mem_type)::BIGINT AS n_types,
          min(nullif(mem_date, '')) AS first_date, max(nullif(mem_date, '')) AS last_date FROM memories WHERE source_id <> '' GROUP BY source_id""",
        "a05_quality_report": f"WITH {QUALITY} SELECT details::BIGINT AS score, count(*)::BIGINT AS n, count(*) FILTER (WHERE v)::BIGINT AS vague FROM g GROUP BY 1",
        "j08_same_conversation": "SELECT mem_no, source_id, (count(*) OVER (PARTITION BY source_id) - 1)::BIGINT AS links FROM memories WHERE source_id <> ''",
        "j09_keyword_edges": edges,
        "j10_commit_links": """WITH n AS (SELECT DISTINCT mem_no, unnest(links.implementations).short_sha AS short_sha FROM memories), c AS (SELECT short_sha, count(*) - 1 AS links FROM n WHERE short_sha IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
          SELECT short_sha, mem_no, links::BIGINT AS links FROM n JOIN c USING (short_sha)""",
        "r09_listing": """WITH m AS (SELECT conv_id, min(source) AS source, max(turn_count) AS turns FROM conversation_meta WHERE conv_id IS NOT NULL GROUP BY 1), d AS (SELECT DISTINCT source_id FROM memories WHERE source_id IS NOT NULL)
          SELECT source, CASE WHEN conv_id IN (SELECT source_id FROM d) THEN 'extracted' WHEN turns > 0 THEN 'open' ELSE 'empty' END AS state, count(*)::BIGINT AS n FROM m GROUP BY 1, 2""",
        "r10_budget_prefix": """WITH s AS (SELECT mem_no, mem_date, length(coalesce(title, '') || chr(10) || coalesce(content, '')) AS size FROM memories WHERE title IS NOT NULL AND mem_date IS NOT NULL),
          t AS (SELECT mem_no, size, sum(size) OVER (ORDER BY mem_date DESC, mem_no ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (ORDER BY mem_date DESC, mem_no) AS place FROM s)
          SELECT mem_no, size::INT AS size, total::BIGINT AS total FROM t WHERE total <= 60000 OR place = 1""",
        "f09_recall": f"SELECT mem_no FROM memories WHERE {ACTIVE} AND mem_type IN ('decision', 'todo') AND {has('retry budget', 'title', 'content', 'reasoning', 'alternatives')}",
        "f10_conversation": f"""WITH f AS (SELECT source_id, max(coalesce(mem_date, '')) AS d, min(mem_no) AS m FROM memories WHERE coalesce(source_id, '') <> '' AND {has('the', 'source_title')} GROUP BY 1),
          c AS (SELECT source_id FROM f ORDER BY d DESC, m LIMIT 1) SELECT mem_no FROM memories WHERE source_id IN (SELECT source_id FROM c)""",
        "f11_recent": "SELECT mem_no FROM memories WHERE mem_date >= '2026-04-02'",
        "f12_topic": f"WITH h AS (SELECT mem_no, {has('session cache', 'title', 'content', 'context', 'impact')} AS hit FROM memories) SELECT mem_no FROM h WHERE hit OR NOT (SELECT coalesce(bool_or(hit), false) FROM h)",
        "f12_topic_fallback": f"WITH h AS (SELECT mem_no, {has('no such topic at all', 'title', 'content', 'context', 'impact')} AS hit FROM memories) SELECT mem_no FROM h WHERE hit OR NOT (SELECT coalesce(bool_or(hit), false) FROM h)",
        "f05_due_conversations": """SELECT conv_id, max(turn_count) AS turns FROM conversation_meta WHERE conv_id IS NOT NULL AND conv_id NOT IN (SELECT source_id FROM memories WHERE source_id IS NOT NULL) GROUP BY 1 HAVING max(turn_count) >= 2""",
        "r08_snippets": "SELECT mem_no, regexp_replace(CASE WHEN length(content) > 120 THEN substring(content, 1, 117) || '...' ELSE content END, '(?i)(the)', '**\\1**', 'g') AS snippet FROM memories WHERE content IS NOT NULL",
        "k06_entries": """SELECT mem_no, mem_type, title, mem_date, nullif(context, '') AS context, content, source_id, nullif(source_title, '') AS source_title, source_type, author,
          CASE WHEN status = 'resolved' THEN 'resolved' ELSE 'active' END AS status FROM memories""",
        "a15_distinct_lists": "SELECT DISTINCT 'author' AS field, author AS value FROM memories WHERE author <> '' UNION ALL SELECT DISTINCT 'type', mem_type FROM memories WHERE mem_type IS NOT NULL",
        "a17_degrees": f"WITH e AS ({edges}) SELECT mem_no, count(*)::BIGINT AS degree FROM (SELECT a AS mem_no FROM e UNION ALL SELECT b FROM e) GROUP BY 1",
        "r12_stratified": "SELECT mem_type, mem_no FROM memories WHERE mem_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mem_type ORDER BY mem_no) <= 10",
    }
