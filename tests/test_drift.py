import json
from collections import Counter
from datetime import datetime

import numpy as np

from skein.operators import drift

SCHEMA = "line_id bigint, file_id bigint, stream_key string, exported_at timestamp, line_no int, raw string, fields string, path string"


def lines(spark, *files):
    out = []
    for f, (stream, day, objects) in enumerate(files):
        for n, o in enumerate(objects):
            out.append((len(out), f, stream, datetime(2024, 1, day), n, o if isinstance(o, str) or o is None else json.dumps(o), None, None))
    return spark.createDataFrame(out, SCHEMA)


def test_changes(spark):
    a = [{"role": "user", "version": 1, "text": "hello there", "old": True}, {"role": "assistant", "version": 1, "text": "and more text", "old": False}]
    b = [{"sender": "user", "version": "1", "text": "some other words", "tags": None}, {"sender": "assistant", "version": "1", "text": "again words"}, "not json", None]
    got = sorted(tuple(r) for r in drift.top_level(lines(spark, ("s", 2, b), ("s", 1, a), ("t", 1, a))).collect())
    assert got == sorted([(0, "renamed", "role", "sender"), (0, "retyped", "version", "version"), (0, "added", "", "tags"), (0, "removed", "old", "")])


def test_rename_needs_type_and_values(spark):
    a = [{"n": 5, "branch": "dev"}] * 3
    b = [{"m": "5", "editor": "stable"}] * 3
    got = sorted(tuple(r)[1:] for r in drift.top_level(lines(spark, ("s", 1, a), ("s", 2, b))).collect())
    assert got == sorted([("removed", "n", ""), ("removed", "branch", ""), ("added", "", "m"), ("added", "", "editor")])


def test_nested_rename_and_move(spark):
    a = [{"agent": {"id": "alpha"}, "x": {"name": "relay/small"}, "y": {"k": 1}}]
    b = [{"agent": {"ident": "alpha"}, "x": {"z": 1}, "y": {"k": 1, "name": "relay/small"}}]
    got = {tuple(r)[1:4] for r in drift.change_report(lines(spark, ("s", 1, a), ("s", 2, b))).collect()}
    assert ("renamed", "agent.id", "agent.ident") in got and ("moved", "x.name", "y.name") in got


def test_assignment_is_cheapest():
    rng = np.random.default_rng(0)
    from itertools import permutations

    for n in range(1, 6):
        cost = rng.random((n, n))
        chosen = drift.assignment(cost)
        assert sorted(chosen) == list(range(n))
        assert abs(sum(cost[i, j] for i, j in enumerate(chosen)) - min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n)))) < 1e-9


def test_carried_is_symmetric():
    a, b = Counter(x=3, y=1), Counter(x=1)
    assert drift.carried(a, b) == drift.carried(b, a) == 0.75 and drift.carried(a, Counter()) == 0


def test_one_table(spark):
    a = [{"role": "user", "n": 1, "pin": True}] * 2
    b = [{"sender": {"name": "user"}, "n": 2, "pin": 0}]
    c = [{"sender": "user", "n": 3, "pin": "false"}]
    df = lines(spark, ("s", 1, a), ("s", 2, c), ("s", 3, b), ("t", 1, ["broken", "[1]"]))
    got = drift.unified(df)
    assert got.count() == 4
    rows = got.orderBy("n").collect()
    role = "role" if "role" in got.columns else "sender"
    assert [r[role] for r in rows] == ["user"] * 4 and [r.pin for r in rows] == [True, True, False, False]
    assert rows[3].n == 3.0


def test_fields_at_any_depth(spark):
    def deep(name, n=40):
        value = {name: "alpha-beta"}
        for i in range(n):
            value = {f"k{i}": value}
        return [value]

    got = [tuple(r)[1:] for r in drift.change_report(lines(spark, ("s", 1, deep("old")), ("s", 2, deep("new")))).collect()]
    assert [(g[0], g[1].split(".")[-1], g[2].split(".")[-1], g[3]) for g in got] == [("renamed", "old", "new", 41)]


def test_no_value_is_lost_where_a_line_has_two_names(spark):
    a = [{"role": "user", "n": 1}] * 3
    b = [{"sender": "user", "n": 2}] * 3
    both = [{"role": "user", "sender": "assistant", "n": 9}]
    got = drift.unified(lines(spark, ("s", 1, a), ("s", 2, b), ("t", 1, both))).where("n = 9").first()
    name, other = ("role", "sender") if "role" in got.asDict() else ("sender", "role")
    assert {got[name], got.other_names[other]} == {"user", "assistant"}


def test_empty(spark):
    df = lines(spark, ("s", 1, [{"a": 1}]))
    assert drift.top_level(df).count() == 0 and drift.top_level(df.limit(0)).count() == 0
