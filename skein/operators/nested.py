"""Deeply nested JSON records to flat, linked tables.

Every record is walked once. The walk yields (path, ordinals, value) triples; triples are grouped
by their longest repeated ancestor, and each group is pivoted into one table whose rows carry the
record's key, the ordinals of all repeated ancestors (the parent link is the ordinals without the
last one) and one column per leaf. Grouping and pivoting happen inside the record that the walk is
in, so no triple is ever shuffled and a record's memory is the only state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIST = "[]"


@dataclass(frozen=True)
class Node:
    """A repeated ancestor: its name and its path from the record, lists marked by []."""

    name: str
    path: tuple[str, ...]

    @property
    def depth(self) -> int:
        return self.path.count(LIST)


#: The repeated parts of a chat session. A list may be absent, null, a single object or JSON text.
SESSION_NODES = (
    Node("request", ("requests", LIST)),
    Node("attachment", ("requests", LIST, "message", "attachments", LIST)),
    Node("range", ("requests", LIST, "message", "attachments", LIST, "ranges", LIST)),
    Node("reply", ("requests", LIST, "response", LIST)),
    Node("edit", ("requests", LIST, "response", LIST, "edits", LIST)),
)


def load_json(text: str | None):
    """The value of a JSON text, or None where it is missing or unreadable."""
    if not text or not text.strip():
        return None
    try:
        return json.loads(text.lstrip("﻿"))
    except (ValueError, RecursionError):
        return None


def as_list(value) -> list:
    """The list a value stands for: itself, one object, or what a JSON text in a string holds."""
    if isinstance(value, str):
        value = load_json(value)
    if isinstance(value, list):
        return value
    return [value] if isinstance(value, dict) else []


def last_session(raw: str | None) -> dict | None:
    """The last readable object with a sessionId of a file: the whole file or one of its lines.

    An object may be bare or the `v` of an object whose kind is 0. None where there is none.
    """
    if raw is None:
        return None

    def session_of(value) -> dict | None:
        if not isinstance(value, dict):
            return None
        kind = value.get("kind")
        if isinstance(kind, (int, float)) and not isinstance(kind, bool) and kind == 0 and isinstance(value.get("v"), dict):
            value = value["v"]
        return value if value.get("sessionId") is not None else None

    whole = load_json(raw)
    if whole is not None:
        return session_of(whole)
    for line in reversed(raw.split("\n")):
        found = session_of(load_json(line))
        if found is not None:
            return found
    return None


def triples(record, nodes: tuple[Node, ...]) -> Iterator[tuple[tuple[str, ...], tuple[int, ...], str | None]]:
    """(path, ordinals, value) of every leaf, and of every element of a declared list.

    Declared lists are coerced by as_list; null elements keep their position but yield nothing.
    Lists that no node declares are one leaf, as JSON text.
    """
    declared = {n.path[:-1] for n in nodes}
    stack = [((), (), record)]
    while stack:
        path, ordinals, value = stack.pop()
        if path in declared:
            items = as_list(value)
            for k in range(len(items) - 1, -1, -1):
                if items[k] is not None:
                    stack.append((path + (LIST,), ordinals + (k,), items[k]))
            continue
        if path and path[-1] == LIST:
            yield path, ordinals, None
        if isinstance(value, dict):
            for key in reversed(value):
                stack.append((path + (key,), ordinals, value[key]))
        elif value is not None:
            yield path, ordinals, value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def pivoted(record, nodes: tuple[Node, ...], root: str) -> Iterator[tuple[str, tuple[int, ...], dict[str, str]]]:
    """Rows (table, ordinals, leaf -> value): the triples grouped by their repeated ancestor."""
    names = {n.path: n.name for n in nodes}
    rows: dict[tuple[str, tuple[int, ...]], dict[str, str]] = {(root, ()): {}}
    for path, ordinals, value in triples(record, nodes):
        cut = max((i + 1 for i, part in enumerate(path) if part == LIST), default=0)
        row = rows.setdefault((names[path[:cut]] if cut else root, ordinals), {})
        if value is not None:
            row[".".join(path[cut:]) or "value"] = value
    for (name, ordinals), leaves in rows.items():
        yield name, ordinals, leaves


ROWS = T.StructType(
    [
        T.StructField("node", T.StringType()),
        T.StructField("ordinals", T.ArrayType(T.IntegerType())),
        T.StructField("leaves", T.MapType(T.StringType(), T.StringType())),
    ]
)


def shred(df: DataFrame, key: str, raw: str, nodes: tuple[Node, ...] = SESSION_NODES, root: str = "session", pick: Callable = last_session, leaves: bool = True) -> DataFrame:
    """Rows (key, node, ordinals, leaves) of the record in column `raw`.

    pick turns a raw text into the record, or None for no rows. With leaves=False the maps stay
    null, for queries that need only the structure. Null, empty and unreadable texts give no
    rows; equal rows each give theirs; other columns of df are not touched.
    """
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *ROWS.fields])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch["key"], batch["raw"]):
                record = pick(text)
                if record is None:
                    continue
                for name, ordinals, values in pivoted(record, nodes, root):
                    out.append((k, name, list(ordinals), values if leaves else None))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["key", "node", "ordinals", "leaves"])
                    out = []
            yield pd.DataFrame(out, columns=["key", "node", "ordinals", "leaves"])

    return df.select(F.col(key).alias("key"), F.col(raw).alias("raw")).mapInPandas(walk, schema)


#: Columns of the session tables: name -> (leaf of the record, type).
SESSION_COLUMNS = {
    "session": {"session_id": ("sessionId", "string"), "version": ("version", "string"), "creation_date": ("creationDate", "string"), "username": ("requesterUsername", "string")},
    "request": {"request_id": ("requestId", "string"), "sent_at": ("timestamp", "bigint"), "model_id": ("modelId", "string"), "text": ("message.text", "string"), "agent_id": ("agent.id", "string")},
    "attachment": {"kind": ("kind", "string"), "name": ("name", "string"), "scheme": ("uri.scheme", "string"), "path": ("uri.path", "string")},
    "range": {"start_line": ("startLine", "bigint"), "end_line": ("endLine", "bigint"), "tags": ("tags", "string")},
    "reply": {"kind": ("kind", "string"), "path": ("uri.path", "string")},
    "edit": {"text": ("text", "string"), "start_line": ("range.startLine", "bigint"), "end_line": ("range.endLine", "bigint")},
}

ORDINALS = ("request_ord", "child_ord", "leaf_ord")


def session_table(rows: DataFrame, node: str, key: str) -> DataFrame:
    """One flat table of shredded sessions: key, ordinals and the typed leaves of the node.

    Leaves that do not have the column's type are null. A message given as a plain string is
    the request's text; a reply's text is the first of value.value, value and result.value.
    """
    depth = {"session": 0} | {n.name: n.depth for n in SESSION_NODES}
    leaf = lambda name: F.col("leaves")[name]
    columns = []
    for name, (path, kind) in SESSION_COLUMNS[node].items():
        column = leaf(path) if kind == "string" else F.expr(f"try_cast(try_cast(leaves['{path}'] as double) as {kind})")
        if (node, name) == ("request", "text"):
            column = F.coalesce(column, leaf("message"))
        columns.append(column.alias(name))
    if node == "reply":
        columns.append(F.coalesce(leaf("value.value"), leaf("value"), leaf("result.value")).alias("text"))
    return rows.where(F.col("node") == node).select(
        F.col("key").alias(key), *(F.col("ordinals")[i].alias(o) for i, o in enumerate(ORDINALS[: depth[node]])), *columns
    )


def other_leaves(rows: DataFrame, key: str) -> DataFrame:
    """(key, node, ordinals, leaf, value) of the leaves of shredded sessions that session_table has no column for, so that nothing of a record is lost."""
    used = {node: [path for path, _ in columns.values()] for node, columns in SESSION_COLUMNS.items()}
    used["request"] = used["request"] + ["message"]
    used["reply"] = used["reply"] + ["value.value", "value", "result.value"]
    taken = F.create_map(*(x for node, paths in used.items() for x in (F.lit(node), F.array(*(F.lit(p) for p in paths)))))
    left = F.map_filter("leaves", lambda k, _: ~F.array_contains(F.element_at(taken, F.col("node")), k))
    return rows.select(F.col("key").alias(key), "node", "ordinals", F.explode(left).alias("leaf", "value"))


def session_nodes(files: DataFrame) -> DataFrame:
    """(file_id, node, request_ord, child_ord, leaf_ord) of every node below a file's session; -1 for no ordinal."""
    rows = shred(files, "file_id", "raw", leaves=False).where("node <> 'session'")
    at = lambda i: F.coalesce(F.get("ordinals", F.lit(i)), F.lit(-1)).cast("int")
    return rows.select(F.col("key").alias("file_id"), "node", *(at(i).alias(o) for i, o in enumerate(ORDINALS)))
