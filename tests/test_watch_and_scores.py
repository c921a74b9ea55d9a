from skein.operators import dedup, scoring
from skein.streaming import watch

SNAP = "conv_id string, modified_ms bigint, turn_count int"


def test_watch(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    put = lambda *rows: spark.createDataFrame(rows, SNAP).coalesce(1).write.mode("append").json(folder)

    def run():
        stream = spark.readStream.schema(SNAP).option("maxFilesPerTrigger", 1).json(folder)
        q = watch.watch(stream, str(tmp_path / "state"), str(tmp_path / "cp"), lambda df, n: seen.extend(sorted((r.conv_id, r.from_turn, r.turn_count) for r in df.collect())))
        assert q.awaitTermination(120)

    put(("a", 10, 2), ("a", 20, 4), ("short", 10, 1), (None, 1, 9))
    run()
    assert seen == [("a", 0, 4)]
    put(("a", 20, 9), ("short", 30, 3), ("b", 5, 2))  # a: not newer than its state
    run()
    assert seen[1:] == [("b", 0, 2), ("short", 1, 3)]
    run()
    assert len(seen) == 3


def test_scores(spark):
    expected = spark.createDataFrame([("f", 0, "todo", ["Cache"], None), ("f", 1, "todo", ["cache"], ["redis"]), ("g", 0, "issue", [], None)], "fixture_id string, pos int, mem_type string, must array<string>, must_not array<string>")
    extracted = spark.createDataFrame([("f", 0, "todo", "a CACHE"), ("f", 1, "todo", "redis cache"), ("h", 0, "issue", "x")], "fixture_id string, pos int, mem_type string, text string")
    got = {r.mem_type: (r.tp, r.fp, r.fn) for r in scoring.by_type(scoring.matches(expected, extracted)).collect()}
    assert got == {"todo": (1, 1, 1), "issue": (0, 1, 1), "decision": (0, 0, 0), "architecture": (0, 0, 0), "convention": (0, 0, 0), "overall": (1, 2, 2)}


def test_keep_first(spark):
    long = "the retry budget of the session cache is bounded by the tenant limit"
    rows = [(1, "s", "todo", "Use the cache", long), (2, "s", "todo", "use The Cache", "other"), (3, "s", "todo", "B", long + " now"), (4, "s", "issue", "C", long), (5, "s", "todo", None, None), (6, "t", "todo", "B", long)]
    df = spark.createDataFrame(rows, "mem_no bigint, source_id string, mem_type string, title string, content string")
    assert sorted(r.mem_no for r in dedup.within(df, "source_id", "mem_no").collect()) == [3, 4, 6]  # an empty content is contained in any


def test_against_stored(spark):
    schema = "mem_no bigint, mem_type string, title string, content string"
    text = "we keep the retry budget in the session cache because every caller retries once more"
    old = spark.createDataFrame([(1, "todo", "a", text)], schema)
    new = spark.createDataFrame([(2, "todo", "b", text.upper()), (3, "issue", "c", text), (4, "todo", "d", text[:50]), (5, "todo", "e", "another matter altogether, quite unlike it"), (6, "todo", "f", None), (7, None, "g", text)], schema)
    assert sorted(r.mem_no for r in dedup.against(new, old, "mem_no").collect()) == [3, 5, 6, 7]
