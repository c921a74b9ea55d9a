import json

from skein.operators import nested

SCHEMA = "file_id bigint, author string, raw string, node string, key string"


def files(spark, *raws):
    return spark.createDataFrame([(i, None, r, "clash", None) for i, r in enumerate(raws)], SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def session(**more):
    return {"sessionId": "s", "creationDate": 1, **more}


def test_nodes_and_ordinals(spark):
    record = session(
        requests=[
            None,
            {"message": {"text": "hi", "attachments": [{"ranges": {"startLine": 1}}, {"ranges": None}, {"ranges": '[{"startLine": 2}, {"startLine": 3}]'}]}, "response": {"value": "x"}},
            {"message": "/explain", "response": [{"edits": {"text": "e"}}, {"edits": [{"text": "f"}, {"text": "g"}]}]},
        ]
    )
    got = rows(nested.session_nodes(files(spark, json.dumps(record))))
    assert got == sorted(
        [
            (0, "request", 1, -1, -1), (0, "request", 2, -1, -1),
            (0, "attachment", 1, 0, -1), (0, "attachment", 1, 1, -1), (0, "attachment", 1, 2, -1),
            (0, "range", 1, 0, 0), (0, "range", 1, 2, 0), (0, "range", 1, 2, 1),
            (0, "reply", 1, 0, -1), (0, "reply", 2, 0, -1), (0, "reply", 2, 1, -1),
            (0, "edit", 2, 0, 0), (0, "edit", 2, 1, 0), (0, "edit", 2, 1, 1),
        ]
    )


def test_which_session(spark):
    wrapped = json.dumps({"kind": 0, "v": session(requests=[{}])})
    last = json.dumps(session(requests='[{"a": 1}, {"b": 2}]'))
    broken = '{"sessionId": "s", "requests": ['
    patch = json.dumps({"kind": 1, "k": ["requests"], "v": {"x": 1}})
    got = rows(nested.session_nodes(files(spark, "\n".join([wrapped, last, patch, broken]), wrapped, broken, "", None, "[]", json.dumps({"requests": [{}]}))))
    assert got == [(0, "request", 0, -1, -1), (0, "request", 1, -1, -1), (1, "request", 0, -1, -1)]


def test_pretty_printed_and_repeated_rows(spark):
    text = json.dumps(session(requests=[{"message": {"text": "a"}}]), indent=2)
    df = files(spark, text).union(files(spark, text))
    assert nested.session_nodes(df).count() == 2


def test_tables_keep_parents_and_types(spark):
    record = session(version=3.1, requests=[{"requestId": "r", "timestamp": "17", "message": "go", "response": [{"value": {"value": "v"}}, {"result": {"value": "w"}}]}])
    shredded = nested.shred(files(spark, json.dumps(record)), "file_id", "raw")
    request = nested.session_table(shredded, "request", "file_id").first()
    assert (request.request_ord, request.request_id, request.sent_at, request.text) == (0, "r", 17, "go")
    replies = nested.session_table(shredded, "reply", "file_id").orderBy("child_ord").collect()
    assert [(r.request_ord, r.child_ord, r.text) for r in replies] == [(0, 0, "v"), (0, 1, "w")]
    assert nested.session_table(shredded, "session", "file_id").first().version == "3.1"


def test_long_and_empty(spark):
    many = json.dumps(session(requests=[{"message": {"text": "x" * 1000}} for _ in range(3000)]))
    assert nested.session_nodes(files(spark, many)).count() == 3000
    assert nested.session_nodes(files(spark, many).limit(0)).count() == 0


def test_no_leaf_is_lost(spark):
    session = {"sessionId": "s", "requests": [{"requestId": "r", "message": {"text": "q", "parts": [1, 2]}, "agent": {"id": "a", "name": "n"}, "response": {"value": "v", "result": {"metadata": {"ms": 5}}}}]}
    df = spark.createDataFrame([(1, json.dumps(session))], "file_id bigint, raw string")
    got = {(r.node, r.leaf, r.value) for r in nested.other_leaves(nested.shred(df, "file_id", "raw"), "file_id").collect()}
    assert got == {("request", "message.parts", "[1, 2]"), ("request", "agent.name", "n"), ("reply", "result.metadata.ms", "5")}
