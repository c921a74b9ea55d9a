"""Queries over nested sessions, written times and drifting schemas (p1, p5, p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.operators import drift, nested, times
from skein.runtime import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per node below the session of a file."""
    return nested.session_nodes(table(spark, d, "copilot_files"))


def p1_table(node: str):
    """The query of one of the flat tables."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.session_table(nested.shred(table(spark, d, "copilot_files"), "file_id", "raw"), node, "file_id")

    return query


def p1_other_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Every leaf of the sessions that no flat table has a column for."""
    return nested.other_leaves(nested.shred(table(spark, d, "copilot_files"), "file_id", "raw"), "file_id")


def p5_times(spark: SparkSession, d: str) -> DataFrame:
    """(src, row_id, raw, norm) of every time of the four tables; norm is null where raw denotes none."""
    t = lambda name: table(spark, d, name)
    rows = cut(times.written_times(t("commits"), t("conversation_meta"), t("copilot_files"), t("memories"), t("authors")))
    return times.normalise(rows).select("src", "row_id", "raw", "norm")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The times that are not yet written in the one form."""
    return p5_times(spark, d).where("norm is not null and norm <> raw").select("src", "row_id", "norm")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Changes of top-level fields between consecutive files of a stream."""
    return drift.top_level(table(spark, d, "turn_exports"))


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    """Every readable line of every file in one set of typed columns."""
    return drift.unified(table(spark, d, "turn_exports"))


QUERIES = {
    "p1_found": p1_found,
    **{f"p1_{node}s" if node != "reply" else "p1_replies": p1_table(node) for node in nested.SESSION_COLUMNS},
    "p1_other_leaves": p1_other_leaves,
    "p5_found": p5_found,
    "p5_times": p5_times,
    "p6_found": p6_found,
    "p6_table": p6_table,
}


def _list(x: str) -> str:
    """The list that a JSON value stands for, as JSON[]."""
    text = f"({x} ->> '$')"
    inner = f"CASE WHEN NOT coalesce(json_valid({text}), false) THEN [] WHEN json_type({text}) = 'ARRAY' THEN {text}::JSON::JSON[] WHEN json_type({text}) = 'OBJECT' THEN [{text}::JSON] ELSE [] END"
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN {x}::JSON[] WHEN 'OBJECT' THEN [{x}] WHEN 'VARCHAR' THEN {inner} ELSE []::JSON[] END"


def _each(source: str, keys: str, value: str, name: str) -> str:
    """The elements of a list with their positions, nulls left out."""
    return f"SELECT * FROM (SELECT {keys}, unnest(range(len(l)))::INT AS {name}, unnest(l) AS e FROM (SELECT {keys}, {_list(value)} AS l FROM {source})) WHERE json_type(e) <> 'NULL'"


def _text(path: str) -> str:
    """A leaf as text: scalars as they are, lists as JSON; null for objects."""
    return f"CASE WHEN json_type(e, '$.{path}') NOT IN ('OBJECT', 'NULL') THEN e ->> '$.{path}' END"


def _whole(path: str) -> str:
    return f"trunc(TRY_CAST({_text(path)} AS DOUBLE))::BIGINT"


TREE = f"""c AS (SELECT file_id, 0 AS n, raw AS j FROM copilot_files WHERE json_valid(raw)
          UNION ALL SELECT file_id, n, j FROM (SELECT file_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS j FROM (SELECT file_id, string_split(raw, chr(10)) AS l FROM copilot_files WHERE NOT coalesce(json_valid(raw), true))) WHERE json_valid(j)),
        s AS (SELECT file_id, n, CASE WHEN json_type(j) = 'OBJECT' AND j ->> '$.kind' = '0' AND json_type(j, '$.v') = 'OBJECT' THEN json_extract(j, '$.v') ELSE j::JSON END AS v FROM c),
        t AS (SELECT file_id, arg_max(v, n) AS v FROM s WHERE json_type(v) = 'OBJECT' AND v ->> '$.sessionId' IS NOT NULL GROUP BY 1),
        o AS (SELECT file_id, v AS e FROM t),
        q AS ({_each('t', 'file_id', "json_extract(v, '$.requests')", 'i')}),
        a AS ({_each('q', 'file_id, i', "json_extract(e, '$.message.attachments')", 'j')}),
        g AS ({_each('a', 'file_id, i, j', "json_extract(e, '$.ranges')", 'k')}),
        p AS ({_each('q', 'file_id, i', "json_extract(e, '$.response')", 'j')}),
        d AS ({_each('p', 'file_id, i, j', "json_extract(e, '$.edits')", 'k')})"""
WHERE = {"session": ("o", 0), "request": ("q", 1), "attachment": ("a", 2), "range": ("g", 3), "reply": ("p", 2), "edit": ("d", 3)}


def _flat(node: str) -> str:
    """The flat table of a node."""
    source, depth = WHERE[node]
    columns = [f"{c} AS {o}" for c, o in zip("ijk"[:depth], nested.ORDINALS)]
    for name, (path, kind) in nested.SESSION_COLUMNS[node].items():
        value = _text(path) if kind == "string" else _whole(path)
        if (node, name) == ("request", "text"):
            value = f"coalesce({value}, {_text('message')})"
        columns.append(f"{value} AS {name}")
    if node == "reply":
        columns.append(f"coalesce({_text('value.value')}, {_text('value')}, {_text('result.value')}) AS text")
    return f"WITH {TREE} SELECT file_id, {', '.join(columns)} FROM {source}"


SQL = {
    **{f"p1_{node}s" if node != "reply" else "p1_replies": _flat(node) for node in WHERE},
    "p1_found": f"""WITH c AS (SELECT file_id, 0 AS n, raw AS j FROM copilot_files WHERE json_valid(raw)
          UNION ALL SELECT file_id, n, j FROM (SELECT file_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS j FROM (SELECT file_id, string_split(raw, chr(10)) AS l FROM copilot_files WHERE NOT coalesce(json_valid(raw), true))) WHERE json_valid(j)),
        s AS (SELECT file_id, n, CASE WHEN json_type(j) = 'OBJECT' AND j ->> '$.kind' = '0' AND json_type(j, '$.v') = 'OBJECT' THEN json_extract(j, '$.v') ELSE j::JSON END AS v FROM c),
        t AS (SELECT file_id, arg_max(v, n) AS v FROM s WHERE json_type(v) = 'OBJECT' AND v ->> '$.sessionId' IS NOT NULL GROUP BY 1),
        q AS ({_each('t', 'file_id', "json_extract(v, '$.requests')", 'i')}),
        a AS ({_each('q', 'file_id, i', "json_extract(e, '$.message.attachments')", 'j')}),
        g AS ({_each('a', 'file_id, i, j', "json_extract(e, '$.ranges')", 'k')}),
        p AS ({_each('q', 'file_id, i', "json_extract(e, '$.response')", 'j')}),
        d AS ({_each('p', 'file_id, i, j', "json_extract(e, '$.edits')", 'k')})
        SELECT file_id, 'request' AS node, i AS request_ord, -1 AS child_ord, -1 AS leaf_ord FROM q UNION ALL SELECT file_id, 'attachment', i, j, -1 FROM a UNION ALL SELECT file_id, 'range', i, j, k FROM g
        UNION ALL SELECT file_id, 'reply', i, j, -1 FROM p UNION ALL SELECT file_id, 'edit', i, j, k FROM d""",
}
