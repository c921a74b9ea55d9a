"""Operators around the store, tested on small cases and against plain Python."""

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from skein.operators import bundle, dedup, extraction, render, reports, store
from skein.sources import fixtures, listing
from skein.streaming import changes

MEM = "mem_no bigint, mem_type string, title string, content string, impact string, reasoning string, alternatives string, context string, mem_date string, status string, author string, source_id string, source_title string, source_type string, file_path string, rank string"


def memories(spark, rows):
    names = [f.strip().split(" ")[0] for f in MEM.split(",")]
    return spark.createDataFrame([tuple(r.get(n, i if n == "mem_no" else None) for n in names) for i, r in enumerate(rows)], MEM)


def plain_reindex(rows):
    """The pass over the store, record by record."""
    grams = [dedup.grams(r["content"]) for r in rows]
    marked = {}
    for i in range(len(rows)):
        if i in marked:
            continue
        for j in range(i + 1, len(rows)):
            if j in marked or rows[i]["mem_type"] != rows[j]["mem_type"]:
                continue
            a, b = grams[i], grams[j]
            shared = len(a & b)
            jac = shared / len(a | b) if a | b else 1.0
            small, large = (i, j) if len(a) <= len(b) else (j, i)
            cont = shared / len(grams[small]) if grams[small] else 1.0
            why = "duplicate" if jac > 0.55 else "subsumed" if cont > 0.75 else None
            if why:
                gone = small if len(rows[small]["content"]) < len(rows[large]["content"]) else large
                marked.setdefault(gone, why)
    return marked


@pytest.mark.parametrize("seed", [1, 2])
def test_reindex_equals_the_plain_pass(spark, seed):
    rng = random.Random(seed)
    base = [" ".join(f"src/m{rng.randrange(30)}.ts w{rng.randrange(12)}" for _ in range(12)) for _ in range(5)]
    rows = []
    for _ in range(60):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}.py"
        rows.append({"mem_type": rng.choice(["decision", "todo"]), "title": "t", "content": " ".join(words[: rng.randrange(8, 25)])})
    rows += [dict(r) for r in rows[:10]]
    got = {r.mem_no: r.reason for r in dedup.reindex(memories(spark, rows)).collect()}
    assert got == plain_reindex(rows) and got
    assert dedup.reindex(memories(spark, [])).count() == 0


def test_rule_assembly():
    rules, refused = extraction.rules_of({"enableOptional": ["jwt"], "rules": [{"name": "own", "pattern": "k-(\\d+)", "group": 1}, {"name": "Bad"}, {"name": "slow", "pattern": "(a+)+"}, {"name": "odd", "pattern": "("}, {"name": "g", "pattern": "x", "group": 2}, 7]}, (extraction.Rule("base", "zz"),))
    assert [r.name for r in rules] == ["base", "jwt", "own"] and len(refused) == 5
    assert [r.name for r in extraction.rules_of({"extendDefaults": False, "enableOptional": ["aws-secret-key"]}, (extraction.Rule("base", "zz"),))[0]] == ["aws-secret-key"]
    assert extraction.redaction_on(True, True, {"enabled": True}) is False and extraction.redaction_on(True, None, None) and extraction.redaction_on(None, None, {"enabled": True}) and not extraction.redaction_on(None, None, {})


def test_group_rule_keeps_what_stands_around(spark):
    df = spark.createDataFrame([("id k-77 and k-8;", "x"), (None, "y"), ("", "z")], "t string, hits string")
    got = extraction.redacted(df, "t", [extraction.Rule("own", r"k-(\d+)(?=[ ;])", group=1), extraction.Rule("word", "and", "&")]).orderBy(F.desc("t")).collect()
    assert got[0].t == "id k-<REDACTED:own> & k-<REDACTED:own>;" and [tuple(h) for h in got[0].hits] == [("own", 2, 3), ("word", 1, 3)]
    assert [r.t for r in got[1:]] == ["", None] and got[2].hits == []
    assert extraction.redacted(df, "t", []).where("size(hits) = 0").count() == 3


def test_choices(spark):
    rows = spark.createDataFrame([("Ab1", "t1", "3", 30), ("ab2", "t2", "2", 20), ("c3", None, "1", None)], "conv_id string, title string, modified_at string, modified_ms bigint")
    ids = lambda df: sorted(r.conv_id for r in df.collect())
    assert ids(extraction.picked(rows, "1,3,9")) == ["Ab1", "c3"] and ids(extraction.picked(rows, "0")) == ids(extraction.picked(rows, "1,x")) == []
    assert ids(extraction.with_prefix(rows, "AB")) == ["Ab1", "ab2"]
    assert ids(extraction.without_ignored(rows, spark.createDataFrame([("t1",), ("c3",), (None,)], "name string"))) == ["ab2"]
    assert ids(extraction.since(rows, "1970-01-01T00:00:00.025Z", datetime.now(timezone.utc))) == ["Ab1"] and ids(extraction.since(rows, "soon", datetime.now(timezone.utc))) == []
    now = datetime(2026, 3, 10, 12, tzinfo=timezone.utc)
    assert extraction.since_instant("2 weeks ago", now).day == 24 and extraction.since_instant("yesterday", now).hour == 0 and extraction.since_instant("3h", now).hour == 9 and extraction.since_instant("2026-13-01", now) is None


def test_answers_of_a_model(spark):
    good = [{"type": "decision", "title": "a", "content": "b", "more": 1}, {"type": "other", "title": "a", "content": "b"}, {"type": "todo", "title": "", "content": "b"}, 5, None]
    df = spark.createDataFrame([(1, "```json\n" + json.dumps(good) + "\n```"), (2, "{}"), (3, None), (4, "[broken")], "conv bigint, answer string")
    assert [(r.conv, r.pos, r.mem_type, r.title) for r in extraction.parsed_results(df).collect()] == [(1, 0, "decision", "a")]


def test_calls_are_tried_again(spark, tmp_path):
    def ask(text):
        tries = tmp_path / text.replace(" ", "_")
        n = int(tries.read_text()) if tries.exists() else 0
        tries.write_text(str(n + 1))
        if text == "never" or n < 1:
            raise RuntimeError("busy")
        return text.upper()

    df = spark.createDataFrame([(1, "on\x00ce"), (2, "never"), (3, None)], "k bigint, t string")
    got = {r.k: (r.answer, r.error) for r in extraction.called(df, "k", "t", ask, wait=0).collect()}
    assert got == {1: ("ONCE", None), 2: (None, "RuntimeError: busy"), 3: (None, None)}
    sizes = extraction.embedded(df.coalesce(1), "k", "t", lambda texts: [[float(len(texts))] for _ in texts], rows_a_call=1).collect()
    assert sorted((r.k, list(r.vector)) for r in sizes) == [(1, [1.0]), (2, [1.0])]


def test_settings():
    assert extraction.provider({"OLLAMA_HOST": "h", "OPENAI_API_KEY": "k", "MODEL": "m"}) == ("OPENAI_API_KEY", "m") and extraction.provider({"ANTHROPIC_API_KEY": "k"}) is None
    assert extraction.author(None, " Ann  Lee! ", "x", None) == "ann-lee" and extraction.author("?", None, None, "") == "unknown"
    assert extraction.enabled({}, "x") and not extraction.enabled({"sources": {"x": {"enabled": False}}}, "x")
    config, warning = extraction.config_of('{"output": {"dir": "y"}, "z": 1}', {"output": {"dir": "x", "lang": "en"}})
    assert config == {"output": {"dir": "y", "lang": "en"}, "z": 1} and warning is None
    assert extraction.config_of("{", {"a": 1})[0] == {"a": 1} and extraction.config_of("{", {})[1]


def test_bundle_files(spark, tmp_path):
    one = {"type": "todo", "title": "t", "date": "2024-01-02", "content": "c", "sourceId": "s", "sourceType": "codex", "status": "x", "context": 7}
    text = lambda **k: json.dumps({"version": 1, "memories": [one], **k})
    row = bundle.read_file(spark, text()).first()
    assert (row.pos, row.mem_type, row.mem_date, row.status, row.context) == (0, "todo", "2024-01-02", "active", None)
    assert bundle.head_of(text())["memoryCount"] == 1 and bundle.head_of(text(memoryCount=5, producer="p"))["producer"] == "p"
    for bad in ("{", "[]", text(version=2), text(version="1"), json.dumps({"version": 1})):
        with pytest.raises(bundle.BundleError):
            bundle.read_file(spark, bad)
    with pytest.raises(bundle.BundleError, match=r"memories\[1\].date"):
        bundle.read_file(spark, text(memories=[one, {**one, "date": "2024-1-2"}, {}]))
    m = memories(spark, [{"mem_type": "todo", "title": "t", "content": "c", "context": "", "status": "resolved"}, {"mem_type": "issue", "title": "u", "content": "d"}])
    assert bundle.write(bundle.entries(m, resolved=True), str(tmp_path / "b"), "2024-01-01") == 2 and spark.read.json(str(tmp_path / "b" / "head")).first().memoryCount == 2
    assert bundle.entries(m).count() == 1


def test_managed_section():
    section = render.managed_section([(0, "## a\n\nb"), (1, "## c")])
    assert render.merge_section(None, section).action == "created"
    added = render.merge_section("# mine\n\n", section)
    assert added.action == "appended" and added.text.startswith("# mine\n\n" + render.START)
    assert render.merge_section(added.text, section).action == "already-up-to-date"
    new = render.merge_section(added.text + "tail", render.managed_section([]))
    assert new.action == "updated" and new.text.startswith("# mine\n\n") and new.text.endswith("\ntail")
    for broken in (render.START, f"{render.END}\n{render.START}", f"{render.START}\n{render.START}\n{render.END}"):
        assert render.merge_section(broken, section).action == "conflict"
    assert render.merge_section("  " + render.START, section).action == "appended"


def test_skill_files():
    assert render.description("Lead.", []) == "Lead." and render.description("Lead.", ["a", "", "b"]) == "Lead. Topics: a, b."
    long = render.description("Lead.", ["x" * 400])
    assert len(long) == 300 and long.endswith("….") and render.description("Lead.", ["a"] * 200).endswith(", ….") and len(render.description("L", ["a"] * 200)) <= 303
    assert render.yaml_scalar("plain") == "plain" and render.yaml_scalar('a: "b"') == '"a: \\"b\\""'
    assert render.skill_file("project-decisions", [("t", "## t\n\nc")]).startswith("---\nname: project-decisions\ndescription: \"")


def test_links_block():
    raw = "# title\n\ntext"
    once = render.with_links(raw, [{"sha": "a"}])
    assert once.startswith("<!--links\n") and once.endswith(raw) and render.with_links(once, []) == raw
    assert render.with_links(once, [{"sha": "b"}]).count("<!--links") == 1 and '"b"' in render.with_links(once, [{"sha": "b"}])


def test_context_text_and_tiers(spark):
    m = memories(spark, [{"mem_type": "decision", "title": f"t{i}", "content": "c" * 400, "mem_date": f"2024-01-{i % 28 + 1:02d}"} for i in range(120)] + [{"mem_type": "todo", "title": "same", "content": "same"}])
    tiers = {r.mem_no: r.tier for r in render.tiered(m).collect()}
    full = [k for k, v in tiers.items() if v == "full"]
    assert len(tiers) == 121 and 60 < len(full) < 80
    rows = render.context_rows(m.where("mem_no >= 118")).orderBy("rank", F.desc("mem_date"), "mem_no").collect()
    text = render.context_text([(r["rank"], r.entry) for r in rows])
    assert text.index("### Key Decisions") < text.index("### Active TODOs") and text.endswith("- [ ] **same**") and "_No records yet._" in render.context_text([])
    assert render.tiered(memories(spark, [])).count() == 0


def test_store_is_written_once(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = [{"mem_type": "todo", "title": "one", "content": "c", "mem_date": "2024-01-01", "author": "ann"}, {"mem_type": "issue", "title": "two", "content": "d", "mem_date": "2024-01-01"}]
    assert store.write(memories(spark, rows), folder) == {"created": 2, "updated": 0, "skipped": 0}
    changed = [{**rows[0], "content": "new"}, rows[1]]
    assert store.write(memories(spark, changed), folder) == {"created": 0, "updated": 0, "skipped": 2}
    assert store.write(memories(spark, changed), folder, force=True) == {"created": 0, "updated": 1, "skipped": 1}
    assert spark.read.parquet(folder).count() == 2 and spark.read.parquet(folder).where("contains(content, 'new')").count() == 1
    vectors = str(tmp_path / "vectors")
    for text in ("x", "y"):
        key = store.remember(spark, {**rows[0], "mem_no": 5, "content": text}, folder, vectors, lambda t: [[1.0, 2.0]] * len(t), "m")
    assert len(key) == 16 and store.version(spark, vectors) == 2 and store.load(spark, vectors, "id string, vector array<float>, model string").count() == 1


def test_changes_of_a_stream(spark, tmp_path):
    folder, out = tmp_path / "in", []
    folder.mkdir()
    stream = lambda: spark.readStream.schema("conv_id string, modified_ms bigint, turn_count int").option("maxFilesPerTrigger", 1).json(str(folder))

    def batch(name, *rows):
        (folder / name).write_text("\n".join(json.dumps(dict(zip(("conv_id", "modified_ms", "turn_count"), r))) for r in rows))
        due = changes.changes(stream(), record_first=True)
        changes.run(due, str(tmp_path / "cp"), lambda df, n: out.extend(tuple(r) for r in df.collect())).awaitTermination()
        got = list(out)
        out.clear()
        return got

    assert batch("a.json", ("x", 10, 4), ("y", 10, 1)) == []
    assert batch("b.json", ("x", 20, 6), ("y", 9, 5), ("z", 5, 9), (None, 1, 1)) == [("x", 20, 6, 4)]
    assert batch("c.json", ("x", 15, 9), ("z", 6, 12), ("y", 30, 1)) == [("z", 6, 12, 9)]


FIXTURE = {"id": "f1", "description": "d", "conversation": {"title": "t", "turns": [{"role": "user", "text": "q"}]}, "expected": [{"type": "todo", "must_contain": ["a"]}]}


def test_fixtures(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(FIXTURE))
    good = fixtures.checked(fixtures.read(spark, str(tmp_path)))
    assert fixtures.turns(good).count() == 1 and fixtures.expectations(good).first().must == ["a"] and fixtures.conversations(good).first().conv_id == "fixture:f1"
    (tmp_path / "b.json").write_text(json.dumps(FIXTURE))
    (tmp_path / "c.json").write_text(json.dumps({**FIXTURE, "id": "f3", "expected": [{"type": "odd", "must_contain": ["a"]}]}))
    (tmp_path / "d.json").write_text("{")
    found = sorted((r.path.rsplit("/", 1)[1], r.problem) for r in fixtures.problems(fixtures.read(spark, str(tmp_path))).collect())
    assert found == [("a.json", "duplicate id"), ("b.json", "duplicate id"), ("c.json", "expected record"), ("d.json", "id")]
    with pytest.raises(fixtures.FixtureError):
        fixtures.checked(fixtures.read(spark, str(tmp_path)))
    samples = spark.createDataFrame([("s1", [[("user", "a"), ("assistant", "b")], [("user", "c")]], ["2024-01-01", None])], "id string, sessions array<array<struct<role string, content string>>>, dates array<string>")
    got = [r.text for r in fixtures.haystack_turns(samples).orderBy("session", "turn").collect()]
    assert got == ["[Session 1 — 2024-01-01]", "a", "b", "c"]
    assert fixtures.of_manifest(samples, spark.createDataFrame([(0, "s1")], "pos int, id string")).count() == 1
    with pytest.raises(fixtures.FixtureError):
        fixtures.of_manifest(samples, spark.createDataFrame([(0, "s2")], "pos int, id string"))


def test_eligible_and_fixture_scores(spark):
    s = spark.createDataFrame([("a", "k", "the answer", True), ("b_abs", "k", "answer", True), ("c", "x", "answer", True), ("d", "k", "20%", True), ("e", "k", "7", False)], "id string, kind string, answer string, answer_is_text boolean")
    assert [r.id for r in reports.eligible(s, ("k",)).collect()] == ["a"]
    out = spark.createDataFrame([("f", "tp"), ("f", "fn"), ("g", "fp"), ("e", "tp")], "fixture_id string, outcome string")
    got = {r.fixture_id: (r.tp, r.fp, r.fn, round(r.f1, 3), r.perfect) for r in reports.by_fixture(out, spark.createDataFrame([("f", None), ("g", None), ("n", None), ("e", "boom")], "fixture_id string, error string")).collect()}
    assert got == {"f": (1, 0, 1, 0.667, False), "g": (0, 1, 0, 0.0, False), "n": (0, 0, 0, 1.0, True), "e": (0, 0, 0, 0.0, False)}


def test_listings(spark, tmp_path):
    (tmp_path / "log").write_text("COMMIT\tabc\t2024\tAnn\tsubject\twith tab\nR100\told\tnew\nM\tx\nCOMMIT\tshort\nCOMMIT\tdef\t2024\tBo\ts2\n")
    got = [tuple(r) for r in listing.file_log(listing.log_records(spark, str(tmp_path / "log"))).orderBy("sha").collect()]
    assert got == [("abc", "2024", "Ann", "subject\twith tab", "renamed", "old"), ("def", "2024", "Bo", "s2", "other", None)]
    projects = spark.createDataFrame([("123", 9, 1), ("my-temp", 9, 1), ("small", 1, 9), ("big", 5, 1), ("none", 0, 99)], "name string, conversations int, modified_ms bigint")
    assert listing.chosen_project(projects, "/home/me/small").first().name == "small" and listing.chosen_project(projects, "/q").first().name == "big"
    items = spark.createDataFrame([("composer.composerData", json.dumps({"allComposers": [{"composerId": "c1", "name": "n"}, {"name": "x"}]})), ("other", "{}")], "key string, value string")
    assert [tuple(r) for r in listing.key_titles(items).collect()] == [("c1", "n")] and listing.chat_rows(items.withColumn("key", F.lit("My.ChatData"))).count() == 2
    turns = spark.createDataFrame([("p/rollout-2024-01-01T00-00-00-abcdef.jsonl", 3, "user", " a  b "), ("p/rollout-2025-01-01T00-00-00-abcdef.jsonl", 12, "user", "late")], "path string, turn int, role string, text string")
    assert sorted(r.title for r in listing.rollout_titles(turns).collect()) == ["a b", "rollout-2025-01-01T00-00-"[:24]]
    assert listing.transcripts_by_uuid(spark.createDataFrame([("a/bddde7b2-81c0-84ec-fb6b-58c94a6ec443.jsonl",), ("a/x.jsonl",)], "path string")).count() == 1
    assert listing.labelled_counts(spark.createDataFrame([("a", "user:\nhi"), ("b", "no")], "path string, raw string")).agg(F.sum("turns")).first()[0] == 2
    folders = spark.createDataFrame([("-home-me-proj",), ("-home-x",)], "folder string")
    assert listing.of_folder(folders, "/home/me/proj").count() == 1 and listing.of_folder(folders, "/nowhere").count() == 2
    assert listing.git("/nonexistent-folder", "status") is None and not listing.in_work_tree("/nonexistent-folder") and not listing.tracked("/nonexistent-folder", "x")
    readers = {"a": ("/a", lambda s, p: s.range(1).select(F.lit("t").alias("text"))), "b": ("/b", lambda s, p: s.range(2).select(F.lit("u").alias("text")))}
    assert listing.detected(readers, lambda p: p == "/b") == ["b"] and listing.all_turns(spark, readers, ["a", "b"]).count() == 3
    assert listing.all_turns(spark, readers, ["a", "b"], {"sources": {"b": {"enabled": False}}}).count() == 1 and listing.all_turns(spark, readers, []) is None
