from skein.llm import conversations, splitting

SCHEMA = "msg_id bigint, conv_id string, source string, project string, role string, text string, turn int, sent_at bigint, ingested_at timestamp, place string, bucket string"
META = "meta_no bigint, conv_id string, turn_count int, role string"
T0 = 1_700_000_000


def chat(spark, *rows):
    return spark.createDataFrame([(i, c, "s", None, r, t, turn, at, None, None, None) for i, (c, r, t, turn, at) in enumerate(rows)], SCHEMA)


def dropped(spark, messages, metas=()):
    found = conversations.verdicts(messages, spark.createDataFrame([(i, c, n, None) for i, (c, n) in enumerate(metas)], META))
    return {r.conv_id for r in found.where("not keep").collect()}


def test_verdicts(spark):
    rows = [
        ("good", "Human ", "q", 1, None), ("good", "AI", "a", 2, None), ("good", "bot", "more", 3, None), ("good", None, "​ ", 4, None), ("good", "system", "rules", 5, None),
        ("same", "assistant", "a", None, T0), ("same", "user", "q", None, T0 * 1000),  # equal instants in two units: the user first
        ("open", "user", "q", 1, None), ("open", "assistant", "a", 2, None), ("open", "user", "q2", 3, None),
        ("twice", "user", "q", 1, None), ("twice", "user", "q2", 2, None), ("twice", "assistant", "a", 3, None),
        ("copy", "user", "q", 1, None), ("copy", "USER", "q", 1, None), ("copy", "assistant", "a", 2, None),
        ("start", "assistant", "a", 1, None), ("start", "user", "q", 2, None), ("start", "assistant", "a", 3, None),
        ("who", "user", "q", 1, None), ("who", "assistant", "a", 2, None), ("who", "undefined", "x", 3, None),
        ("few", "user", "q", 1, None), ("few", "assistant", "a", 2, None),
        ("blank", "user", None, 1, None), (None, "user", "q", 1, None),
    ]
    metas = [("few", 3), ("few", None), ("good", 3), ("only", 2), ("copy", 0), (None, 1)]
    assert dropped(spark, chat(spark, *rows), metas) == {"open", "twice", "start", "who", "few", "blank", "only"}


def test_empty_tables(spark):
    assert dropped(spark, chat(spark, ("a", "user", "q", 1, None)).limit(0)) == set()
    assert dropped(spark, chat(spark, ("a", "user", "q", 1, None)).limit(0), [("m", None)]) == {"m"}


def test_positions_and_text(spark):
    messages = chat(spark, *[("c", "user" if i % 2 == 0 else "assistant", f"t{i}", i * 700, None) for i in range(40)])
    got = conversations.rebuilt(messages, spark.createDataFrame([], META)).orderBy("position").collect()
    assert [(r.position, r.text) for r in got] == [(i, f"t{i}") for i in range(40)]


def test_clock_offset_only_where_most_are_infeasible(spark):
    early = [row for k in range(4) for row in ((f"e{k}", "user", "q", None, T0 + 60), (f"e{k}", "assistant", "a", None, T0 + 50 - k))]
    offsets = conversations.clock_offsets(conversations.usable_messages(chat(spark, *early))).collect()
    assert (offsets[0].offset_ns, offsets[0].infeasible, offsets[0].left_infeasible) == (13 * 10**9, 4, 0)
    mixed = early[:2] + [row for k in range(4) for row in ((f"g{k}", "user", "q", None, T0), (f"g{k}", "assistant", "a", None, T0 + 5))]
    assert conversations.clock_offsets(conversations.usable_messages(chat(spark, *mixed))).first().offset_ns == 0
    assert dropped(spark, chat(spark, *mixed)) == {"e0"}


def test_skewed_source_is_merged_by_corrected_clocks(spark):
    """Replies of one source lie 90 s behind; without the shift every conversation of it would be dropped."""
    rows = [row for k in range(6) for i in range(5) for row in ((f"s{k}", "user", f"q{i}", None, T0 + 200 * i), (f"s{k}", "assistant", f"a{i}", None, T0 + 200 * i + 20 + k - 90))]
    rows += [("lost", "user", "q0", None, T0), ("lost", "user", "q1", None, T0 + 500), ("lost", "assistant", "a1", None, T0 + 500 + 20 - 90)]
    messages = chat(spark, *rows)
    found = conversations.clock_offsets(conversations.usable_messages(messages)).first()
    assert 70 * 10**9 <= found.offset_ns <= 195 * 10**9 and found.infeasible >= 30
    assert dropped(spark, messages) == {"lost"}
    got = conversations.rebuilt(messages, spark.createDataFrame([], META)).where("conv_id = 's0'").orderBy("position").collect()
    assert [r.text for r in got] == [x for i in range(5) for x in (f"q{i}", f"a{i}")]


def check(text, own, limit, overlap):
    assert "".join(own) == text
    for p, q in zip(splitting.with_overlap(own, overlap), splitting.with_overlap(own, overlap)[1:]):
        assert len(p) <= limit and len(q) <= limit and q.startswith(p[-overlap:])


def test_pieces():
    prose = " ".join(f"Sentence number {i} ends here." for i in range(900))
    own = splitting.pieces(prose, 8000, 800)
    check(prose, own, 8000, 800)
    assert all(p.rstrip().endswith(".") for p in own) and len(own) < 12
    for text in ("x" * 50_000, "字" * 20_000, "a\n\n" * 9000, "é́" * 9000, "\n" * 9000, " " * 9000 + "end"):
        check(text, splitting.pieces(text, 8000, 800), 8000, 800)
    assert splitting.pieces("short", 8000, 800) == ["short"] and splitting.pieces("", 10, 2) == [""]
    assert splitting.pieces("y" * 8000, 8000, 800) == ["y" * 8000]


def test_split_texts(spark):
    rows = [("c", "user", t, 1, None) for t in (None, "", "x" * 8000, "w " * 4001, "w " * 4001)]
    got = splitting.split_texts(chat(spark, *rows), "turn", "msg_id", "text")
    assert {r.item_id for r in got.collect()} == {"3", "4"}
    assert splitting.split_texts(chat(spark, *rows).limit(0), "turn", "msg_id", "text").count() == 0


def test_large_conversations_are_split_as_one_heap(spark):
    """Above and below 400,000 characters, the pieces are those of one heap over all segments of the conversation."""
    for n in (120, 399, 402, 700):
        rows = [("big", "user" if i % 2 == 0 else "assistant", f"message {i} " + "words and more. " * (40 + i * i % 37) + ("\n\nsecond paragraph." * (i % 4)), i, None) for i in range(n)] + [("small", "user", "q", 1, None)]
        texts = [r[2] for r in rows[:n]]
        got = splitting.split_conversations(chat(spark, *rows)).orderBy("piece").collect()
        assert {r.item_id for r in got} == {"big"} and [r.piece for r in got] == list(range(len(got)))
        segments = []
        for i, t in enumerate(texts):
            own = list(splitting.atoms(t + ("\n\n" if i + 1 < n else ""), 18_000))
            segments += own[:-1] + [(own[-1][0], splitting.PARAGRAPH if i + 1 < n else own[-1][1])]
        want = splitting.merged(segments, 20_000, 2_000)
        assert [r.text[len(r.text) - r.own_length :] for r in got] == want and "".join(want) == "\n\n".join(texts)
        assert max(len(r.text) for r in got) <= 20_000
        for p, q in zip(got, got[1:]):
            assert q.text[: len(q.text) - q.own_length] == p.text[-2000:]


def test_conversation_of_one_huge_message_and_many_short_ones(spark):
    rows = [("c", "user", "x" * 50_000, 0, None)] + [("c", "assistant", f"ok {i}", i + 1, None) for i in range(30)]
    got = splitting.split_conversations(chat(spark, *rows)).orderBy("piece").collect()
    assert "".join(r.text[len(r.text) - r.own_length :] for r in got) == "\n\n".join(r[2] for r in rows) and max(len(r.text) for r in got) <= 20_000
