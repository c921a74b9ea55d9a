"""Schemas that drift between the files of a stream.

Every file's lines are reduced to a tree of fields, each with its JSON type and a profile of its
values. Consecutive trees of a stream are compared by a constrained tree edit distance: the
children of matched objects are assigned to each other at minimum cost, where a match under the
same name is free but for a change of type, a match under another name (rename, or move where the
parent differs) costs by how little the values carry on, and the rest is deleted or added. The
edit scripts give the change report; their renames, composed, give the projection that puts every
file into one table.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.neighbours import with_previous

#: A rename must carry on at least this share of the values' shapes; below it, delete and add.
CARRY_ON = 0.5
#: Words, written forms and key sets are profiled by this many hash cells, so that a profile stays small.
CELLS = 4096
SEP = "\x1f"


def json_type(value) -> str:
    """string, number, boolean, object, array; '' for null, which has none."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "boolean"
    for kind, name in ((str, "string"), ((int, float), "number"), (dict, "object"), (list, "array")):
        if isinstance(value, kind):
            return name
    return ""


def shape_of(value) -> str:
    """What the values of a field have in common.

    Words without digits stand for themselves (hashed), since such fields are enumerations;
    texts with blanks are one shape; texts with digits keep their letters, digits and marks as
    runs; numbers keep their magnitude; objects their keys; arrays their first element's shape.
    """
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return f"num{len(str(abs(int(value)))) if np.isfinite(value) else 'x'}"
    if isinstance(value, str):
        if re.search(r"\s", value.strip()) or len(re.findall(r"[⺀-鿿]", value)) > 3:
            return "text"
        if not re.search(r"\d", value):
            return f"w{cell(value)}"
        return f"c{cell(re.sub(r'[A-Za-z0-9]*\d[A-Za-z0-9]*', '9', value))}"
    if isinstance(value, dict):
        return f"o{cell(','.join(sorted(value)))}"
    if isinstance(value, list):
        depth = 0
        while isinstance(value, list) and value:
            value, depth = value[0], depth + 1
        return f"[{depth}" + (shape_of(value) if not isinstance(value, list) else "")
    return ""


def cell(text: str) -> int:
    """The hash cell of a text."""
    return zlib.crc32(text.encode("utf-8", "replace")) % CELLS


def walk(value: dict) -> Iterator[tuple[tuple[str, ...], object]]:
    """(path, value) of every field of an object at any depth, parents first."""
    todo = [((), value)]
    while todo:
        prefix, parent = todo.pop()
        for name, child in parent.items():
            path = prefix + (name,)
            yield path, child
            if isinstance(child, dict):
                todo.append((path, child))


def profile(lines: DataFrame) -> DataFrame:
    """(file_id, path, n, types map, shapes map) of every field of the files' readable lines.

    Counting starts inside each task, so that a file with many lines is pre-aggregated before
    the shuffle. Unreadable lines and lines that are not objects do not count.
    """
    schema = "file_id bigint, path string, type string, shape string, n bigint"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for file_id, raw in zip(batch["file_id"], batch["raw"]):
                try:
                    value = json.loads(raw)
                except (TypeError, ValueError, RecursionError):
                    continue
                if isinstance(value, dict):
                    for path, child in walk(value):
                        seen[(file_id, SEP.join(path), json_type(child), shape_of(child))] += 1
            if len(seen) > 50_000:
                yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["file_id", "path", "type", "shape", "n"])
                seen.clear()
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["file_id", "path", "type", "shape", "n"])

    cells = lines.select("file_id", "raw").mapInPandas(count, schema).groupBy("file_id", "path", "type", "shape").agg(F.sum("n").alias("n"))
    return cells.groupBy("file_id", "path").agg(F.collect_list(F.struct("type", "shape", "n")).alias("cells"))


class Tree:
    """The fields of a file: types and shape counts by path."""

    def __init__(self, fields) -> None:
        self.types: dict[tuple[str, ...], str] = {}
        self.shapes: dict[tuple[str, ...], Counter] = {}
        for field in fields if fields is not None else []:
            path = tuple(field["path"].split(SEP))
            kinds, shapes = Counter(), Counter()
            for cell in field["cells"]:
                if cell["type"]:
                    kinds[cell["type"]] += cell["n"]
                    shapes[cell["shape"]] += cell["n"]
            self.types[path] = max(kinds, key=lambda k: (kinds[k], k)) if kinds else ""
            self.shapes[path] = shapes
        self.below: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
        for path in sorted(self.types):
            self.below.setdefault(path[:-1], []).append(path)

    def children(self, parent: tuple[str, ...]) -> list[tuple[str, ...]]:
        return self.below.get(parent, [])


def carried(a: Counter, b: Counter) -> float:
    """How much of either profile the other one covers, 0 to 1."""
    total_a, total_b = sum(a.values()), sum(b.values())
    if not total_a or not total_b:
        return 0.0
    return sum(min(a[s] / total_a, b[s] / total_b) for s in a.keys() & b.keys())


def assignment(cost: np.ndarray) -> list[int]:
    """The column of each row in a cheapest assignment of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while match[j0]:
            used[j0] = True
            row = match[j0]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


Path = tuple[str, ...]
Edit = tuple[str, Path, Path]


def edit_script(old: Tree, new: Tree) -> list[Edit]:
    """The cheapest (kind, old path, new path) edits between two trees; () for no path.

    Same names always match. Of the others a pair may match where both have the same type and the
    values carry on; deleting and adding one field each cost 1, a rename 2 * (1 - carried).
    """
    script: list[Edit] = []
    todo: list[tuple[Path, Path]] = [((), ())]
    while todo:
        parent_old, parent_new = todo.pop()
        a, b = old.children(parent_old), new.children(parent_new)
        names_a, names_b = {p[-1] for p in a}, {p[-1] for p in b}
        gone, fresh = [p for p in a if p[-1] not in names_b], [p for p in b if p[-1] not in names_a]
        pairs = [(p, parent_new + (p[-1],)) for p in a if p[-1] in names_b]
        if gone and fresh:
            n = len(gone) + len(fresh)
            cost = np.zeros((n, n))
            cost[: len(gone), len(fresh) :] = 1
            cost[len(gone) :, : len(fresh)] = 1
            for i, p in enumerate(gone):
                for j, q in enumerate(fresh):
                    alike = carried(old.shapes[p], new.shapes[q]) if old.types[p] and old.types[p] == new.types[q] else 0
                    cost[i, j] = 2 * (1 - alike) if alike >= CARRY_ON else 4
            chosen = assignment(cost)
            renamed = [(gone[i], fresh[j]) for i, j in enumerate(chosen[: len(gone)]) if j < len(fresh) and cost[i, j] < 2]
            pairs += renamed
            script += [("renamed", p, q) for p, q in renamed]
            gone = [p for p in gone if p not in {x for x, _ in renamed}]
            fresh = [q for q in fresh if q not in {y for _, y in renamed}]
        script += [("removed", p, ()) for p in gone] + [("added", (), q) for q in fresh]
        for p, q in pairs:
            if p[-1] == q[-1] and old.types[p] and new.types[q] and old.types[p] != new.types[q]:
                script.append(("retyped", p, q))
            elif old.types[p] == "object" and new.types[q] == "object":
                todo.append((p, q))
    return script


def moved(script: list[Edit], old: Tree, new: Tree) -> list[Edit]:
    """Turns a removal and an addition of a name under different parents into a move where the values carry on."""
    out = list(script)
    for _, p, _ in [e for e in script if e[0] == "removed"]:
        for _, _, q in [e for e in out if e[0] == "added"]:
            if p[:-1] != q[:-1] and p[-1] == q[-1] and old.types[p] and old.types[p] == new.types[q] and carried(old.shapes[p], new.shapes[q]) >= CARRY_ON:
                out.remove(("removed", p, ()))
                out.remove(("added", (), q))
                out.append(("moved", p, q))
                break
    return out


def file_trees(lines: DataFrame) -> DataFrame:
    """(file_id, stream_key, exported_at, fields) of every file with its predecessor's prev_file_id and prev_fields.

    Files of a stream are ordered by exported_at, then file_id. A file without readable lines
    has no fields and takes no place in the order.
    """
    files = lines.groupBy("file_id").agg(F.min("stream_key").alias("stream_key"), F.min("exported_at").alias("exported_at"))
    fields = profile(lines).groupBy("file_id").agg(F.collect_list(F.struct("path", "cells")).alias("fields"))
    trees = files.join(fields, "file_id")
    return with_previous(trees, "stream_key", F.date_trunc("month", "exported_at"), ["exported_at", "file_id"], ["file_id", "fields"])


def change_report(lines: DataFrame) -> DataFrame:
    """(file_id, change_kind, old_field, new_field, depth) of every change against the file before in the stream.

    Fields are dotted paths, '' for none; depth is 1 for a field at the top of the lines. Kinds
    are added, removed, renamed, moved and retyped. The first file
    of a stream has no changes. Null, repeated and unreadable lines change nothing.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file_id, before, now in zip(batch["file_id"], batch["prev_fields"], batch["fields"]):
                old, new = Tree(before), Tree(now)
                for kind, p, q in moved(edit_script(old, new), old, new):
                    out.append((file_id, kind, ".".join(p), ".".join(q), max(len(p), len(q))))
            yield pd.DataFrame(out, columns=["file_id", "change_kind", "old_field", "new_field", "depth"])

    pairs = file_trees(lines).where("prev_file_id is not null").select("file_id", "prev_fields", "fields")
    return pairs.mapInPandas(compare, "file_id bigint, change_kind string, old_field string, new_field string, depth int")


def top_level(lines: DataFrame) -> DataFrame:
    """The changes of the fields at the top of the lines; a move from or to a deeper level is a removal or an addition."""
    report = change_report(lines)
    flat = report.where("depth = 1").drop("depth")
    deep = report.where("change_kind = 'moved'")
    out = deep.where("not contains(old_field, '.')").select("file_id", F.lit("removed").alias("change_kind"), "old_field", F.lit("").alias("new_field"))
    into = deep.where("not contains(new_field, '.')").select("file_id", F.lit("added").alias("change_kind"), F.lit("").alias("old_field"), "new_field")
    return flat.unionByName(out).unionByName(into)


#: More field names than this are data in the keys, not a schema.
MOST_NAMES = 10_000


def name_groups(report: DataFrame) -> dict[str, str]:
    """Field name -> canonical name, for every name that a rename at the top of the lines joins to others.

    Counts of renames per pair of names are aggregated by Spark; the pairs, bounded by the names
    of the schema (MOST_NAMES, else an error), are joined on the driver. The canonical name is
    the one that takes part in most renames.
    """
    edges = report.where("change_kind = 'renamed' and depth = 1").groupBy("old_field", "new_field").agg(F.count("*").alias("n")).limit(MOST_NAMES + 1).collect()
    if len(edges) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} renamed pairs: the keys hold data")
    weight: Counter = Counter()
    root: dict[str, str] = {}

    def find(name: str) -> str:
        while root.setdefault(name, name) != name:
            name = root[name]
        return name

    for e in edges:
        weight[e.old_field] += e.n
        weight[e.new_field] += e.n
        root[find(e.old_field)] = find(e.new_field)
    best: dict[str, str] = {}
    for name in sorted(root, key=lambda n: (weight[n], n)):
        best[find(name)] = name
    return {name: best[find(name)] for name in root}


def unified(lines: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """Every readable line in one set of typed columns: file_id, line_id, line_no, then one column per field.

    The projection is compiled from the edit scripts: a column reads whichever of its names a
    line has. A column is double where all its values are numbers, boolean where they are
    booleans, 0, 1 or the texts of these, else string: scalars as text, {"name": x} as x, a list of {"text": x} as its texts, any
    other object or list as JSON. Where one line has several names of a column, the column has
    the canonical name's value and the map other_names those of the others. Lines that are not
    readable objects are left out.
    """
    report = change_report(lines) if report is None else report
    canonical = name_groups(report)
    kinds = profile(lines).where(~F.contains("path", F.lit(SEP))).select("path", F.explode("cells").alias("c"))
    kinds = kinds.groupBy("path", "c.type").agg(F.sum("c.n").alias("n")).where("type <> ''").limit(MOST_NAMES + 1).collect()
    if len(kinds) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} field names: the keys hold data")
    fields: dict[str, dict] = {}
    for k in kinds:
        f = fields.setdefault(canonical.get(k.path, k.path), {"names": set(), "types": set()})
        f["names"].add(k.path)
        f["types"].add(k.type)
    parsed = lines.select("file_id", "line_id", "line_no", F.try_parse_json("raw").alias("__v"))
    parsed = parsed.where(F.schema_of_variant("__v").startswith("OBJECT"))

    def text(name: str):
        at = "$['" + name.replace("'", "\\'") + "']"
        kind = F.schema_of_variant(F.try_variant_get("__v", at, "variant"))
        parts = F.expr(f"array_join(transform(try_variant_get(__v, \"{at}\", 'array<struct<text string>>'), x -> x.text), '\n')")
        whole = F.try_variant_get("__v", at, "string")
        return F.when(kind.startswith("OBJECT"), F.coalesce(F.try_variant_get("__v", at + "['name']", "string"), whole)).when(
            kind.startswith("ARRAY"), F.coalesce(F.when(F.contains(kind, F.lit("text: STRING")), parts), whole)
        ).otherwise(whole)

    columns, spare = [], []
    for name in sorted(fields):
        names = sorted(fields[name]["names"], key=lambda n: (n != name, n))
        column = F.coalesce(*(text(n) for n in names))
        for i, n in enumerate(names[1:], 1):
            taken = F.coalesce(*(text(m) for m in names[:i]))
            spare.append(F.when(taken.isNotNull() & text(n).isNotNull(), F.struct(F.lit(n).alias("key"), text(n).alias("value"))))
        types = fields[name]["types"]
        if "boolean" in types and types <= {"boolean", "number", "string"}:
            column = F.when(column.isin("1", "true"), F.lit(True)).when(column.isin("0", "false"), F.lit(False))
        elif types == {"number"}:
            column = column.try_cast("double")
        columns.append(column.alias(name if name not in ("file_id", "line_id", "line_no") else f"field_{name}"))
    unused = F.array_compact(F.array(*spare)) if spare else F.array().cast("array<struct<key:string,value:string>>")
    clash = "other_names" in fields
    return parsed.select("file_id", "line_id", "line_no", *columns, F.map_from_entries(unused).alias("field_other_names" if clash else "other_names"))
