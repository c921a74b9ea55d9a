from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import tokens

SCHEMA = "doc_id bigint, text string, ids string, key string"
ENC = tokens.encoding(tokens.rank_bytes())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB1 '’.\n\t　字é🙂 "), max_size=80))
def test_safe_pieces(text):
    ids = [i for p in tokens.safe_pieces(text, 5) for i in ENC.encode_ordinary(p)]
    assert ids == ENC.encode_ordinary(text)


def test_rows(spark):
    texts = [None, "", " ", "plain text", "<|endoftext|> stays text", "字" * 30_000, "word " * 30_000, "plain text", "🙂é\x00"]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.ids for r in tokens.with_ids(df, "doc_id", "text").collect()}
    assert got == {i: ENC.encode_ordinary(t or "") for i, t in enumerate(texts)} and got[0] == [] and got[1] == []
    assert 50256 not in got[4]
    counts = {r.doc_id: r.n for r in tokens.with_counts(df, "text", "n").collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    back = tokens.decoded(tokens.with_ids(df, "doc_id", "text"), "ids", "back").collect()
    assert {r.doc_id: r.back for r in back} == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.with_ids(df.limit(0), "doc_id", "text").count() == 0


def test_pieces_of_any_text_give_its_ids():
    import random

    enc = tokens.encoding(tokens.rank_bytes())
    rng = random.Random(5)
    parts = ["汉字", "，", "。", "don't", "it's", "'", "''s", " ", "  ", "\n", "\n\n", "\t", "\u3000", "\x1c", "\x85", "\u00a0", "12", "３", "é́", "word", "!", "?!", "’s", "😀", "ＡＢ", "_", "-", "'re", "s", "t"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 60)))
        pieces = list(tokens.safe_pieces(text, rng.randrange(1, 9)))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text), repr(text)
    han = "汉字，" * 40_000
    assert max(map(len, tokens.safe_pieces(han))) < 20_010
