import json

from skein.sources import records, transcripts

LINES = "path string, line_no int, line string"


def got(df):
    return [(r.role, r.text) for r in df.orderBy("turn").collect()]


def lines(spark, *objects):
    return spark.createDataFrame([("f", i, o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)], LINES)


def test_editor_lines(spark):
    part = lambda t: {"type": "text", "text": t}
    df = lines(spark, {"role": "user", "message": {"content": [part("<user_query>\n hi \n</user_query>")]}}, {"role": "system", "message": {"content": [part("x")]}}, {"role": "assistant", "message": {"content": [part("a"), {"type": "tool_use", "text": "t"}, part("b")]}}, {"role": "user", "message": {"content": "plain"}}, "broken", "", {"role": "user", "message": {"content": []}})
    assert got(transcripts.editor_jsonl(df)) == [("user", "hi"), ("assistant", "a\nb")]


def test_agent_and_rollout_lines(spark):
    df = lines(spark, {"role": "user", "content": " q "}, {"role": "assistant", "message": {"content": [{"type": "text", "text": " a "}, {"type": "image"}]}}, {"role": "user", "message": {"content": "s"}}, {"type": "x"})
    assert got(transcripts.agent_jsonl(df)) == [("user", "q"), ("assistant", "a"), ("user", "s")]
    message = lambda role, kind, t: {"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": kind, "text": t}]}}
    df = lines(spark, {"type": "session_meta"}, message("user", "input_text", "q"), message("developer", "input_text", "d"), message("assistant", "output_text", "a"), {"type": "compacted", "payload": {"message": "sum"}}, {"type": "response_item"})
    assert got(transcripts.rollout_jsonl(df)) == [("user", "q"), ("assistant", "a"), ("assistant", "sum")]
    assert transcripts.titles(transcripts.rollout_jsonl(df)).first().title == "q"


def test_labelled_text_and_database(spark):
    raw = "user:\nfirst\nline\n\nassistant:\nreply\nuser:\n\nassistant:  \nagain"
    assert got(transcripts.labelled_text(spark.createDataFrame([("f", raw)], "path string, raw string"))) == [("user", "first\nline"), ("assistant", "reply"), ("assistant", "again")]
    chat = {"messages": [{"type": "Human", "text": "q"}, {"sender": "cascade", "content": [{"type": "text", "text": "a"}]}, {"role": "tool", "text": "x"}, {"role": "user", "text": " "}]}
    df = spark.createDataFrame([("a", json.dumps([chat, chat])), ("b", json.dumps({"sessions": [chat]})), ("c", json.dumps(chat)), ("d", "?"), ("e", None)], "path string, raw string")
    rows = transcripts.database_chats(df).collect()
    assert len(rows) == 8 and {(r.path, r.chat) for r in rows} == {("a", 0), ("a", 1), ("b", 0), ("c", 0)} and {(r.role, r.text) for r in rows} == {("user", "q"), ("assistant", "a")}


def test_markdown_round_trip(spark):
    schema = "mem_no bigint, title string, mem_date string, author string, status string, source_type string, source_id string, source_title string, context string, content string, reasoning string, alternatives string, impact string"
    rows = [(1, "A title", "2024-05-06", "ann", "resolved", "cursor", "0123456789", "Talk", "why", "two\n\nparagraphs", "because", None, "big"), (2, "B", "2024-05-07", None, "active", "codex", "ab", "", None, "only", None, None, None)]
    for zh in (True, False):
        raw = records.rendered(spark.createDataFrame(rows, schema), zh)
        for windows in (False, True):
            back = records.markdown(raw.selectExpr("concat('s/decisions/f', mem_no, '.md') as path", "replace(raw, '\n', '\r\n') as raw" if windows else "raw")).orderBy("path").collect()
            assert [(r.title, r.mem_date, r.author, r.status, r.source_id, r.context, r.content, r.reasoning, r.alternatives, r.impact) for r in back] == [
                ("A title", "2024-05-06", "ann", "resolved", "01234567", "why", "two\n\nparagraphs", "because", None, "big"), ("B", "2024-05-07", None, "active", "ab", "", "only", None, None, None)
            ]


def test_commit_log(spark):
    text = "noise\nBCOMMIT\tfull1\ts1\t2024-01-01T00:00:00Z\tAnn\tsub\tject\nBODY_START\nline a\n\nline b\nBODY_END\n\nsrc/a.ts\n src/b.ts\nBCOMMIT\tfull2\ts2\td\tBob\tx\nBODY_START\nBODY_END\nBCOMMIT\tbad"
    df = spark.createDataFrame([("l", i, x) for i, x in enumerate(text.split("\n"))], "log string, line_no int, line string")
    rows = records.commit_log(df).orderBy("sha").collect()
    assert [(r.sha, r.subject, r.body, r.paths) for r in rows] == [("s1", "sub\tject", "line a\n\nline b", ["src/a.ts", "src/b.ts"]), ("s2", "x", "", [])]
