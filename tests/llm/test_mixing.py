from skein.llm import mixing

DOCS = "doc_id bigint, text string, source string, n_tokens string, copies string"
GOALS = "mix_name string, source string, weight double, max_repeats int"


def make(spark, docs, goals):
    return spark.createDataFrame([(i, t, s, None, None) for i, (t, s) in enumerate(docs)], DOCS), spark.createDataFrame(goals, GOALS)


def test_shares_caps_and_copies(spark):
    docs = [(f"big text number {i} " + "alpha beta " * (i % 9), "big") for i in range(900)]
    docs += [(f"small thing {i} " + "gamma " * (i % 5), "small") for i in range(30)]
    docs += [("big text number 1 " + "alpha beta " * 1, "big")] * 20 + [(None, "big"), ("", "small"), ("orphan", None)]
    goals = [("m", "big", 3.0, 1), ("m", "small", 1.0, 4), ("m", "gone", 1.0, 2), ("n", "big", 5.0, 2), ("x", "gone", 1.0, 1)]
    selection, plan = mixing.select(*make(spark, docs, goals))
    rows = selection.collect()
    used = {}
    for r in rows:
        used[(r.mix_name, docs[r.doc_id][0])] = used.get((r.mix_name, docs[r.doc_id][0]), 0) + r.copies
    caps = {("m", "big"): 1, ("m", "small"): 4, ("n", "big"): 2}
    assert all(n <= caps[(m, next(s for t2, s in docs if t2 == t))] for (m, t), n in used.items())
    got = {(r.mix_name, r.source): r for r in mixing.shares(selection, plan).collect()}
    assert abs(got[("m", "big")].actual_share - 0.75) < 0.01 and abs(got[("m", "small")].actual_share - 0.25) < 0.01
    assert got[("m", "gone")].actual_share == 0 and not got[("m", "gone")].available and abs(got[("m", "gone")].target_share - 0.2) < 1e-9
    assert got[("n", "big")].max_copies == 2 and got[("x", "gone")].tokens == 0
    again = mixing.select(*make(spark, docs, goals))[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_total_beyond_capacity(spark):
    docs, goals = make(spark, [("one two three", "a"), ("four five", "b")], [("m", "a", 1.0, 2), ("m", "b", 1.0, 3)])
    rows = {r.source: r.copies for r in mixing.select(docs, goals, total_tokens=10**6)[0].collect()}
    assert rows == {"a": 2, "b": 3}


def test_empty(spark):
    docs, goals = make(spark, [("one", "a")], [("m", "a", 1.0, 1)])
    assert mixing.select(docs.limit(0), goals)[0].count() == 0
    assert mixing.select(docs, goals.limit(0))[0].count() == 0


def test_inclusion_follows_the_size_of_each_text(spark):
    docs = [(f"t{i} " + "word " * (1 + i * i % 61), "big") for i in range(400)] + [("huge " + "word " * 4000, "big"), ("x " * 50, "small")]
    rows, _ = mixing.sampled(*make(spark, docs, [("m", "big", 9.0, 1), ("m", "small", 1.0, 20)]))
    got = [r for r in rows.where("source = 'big'").collect()]
    assert abs(sum(r.inclusion * r.n_tokens for r in got) - got[0].rest) < 1e-6 * got[0].rest + 1e-6
    open_ = [r for r in got if r.inclusion < 1]
    slopes = [r.inclusion / r.n_tokens for r in open_]
    assert len(open_) >= 400 and max(slopes) - min(slopes) < 1e-9 and all(r.n_tokens >= max(o.n_tokens for o in open_) for r in got if r.inclusion == 1)
    chosen, _ = mixing.select(*make(spark, docs, [("m", "big", 9.0, 1), ("m", "small", 1.0, 20)]))
    sizes = [r.n_tokens for r in chosen.where("source = 'big' and n_tokens < 1000").collect()]
    assert sum(sizes) / len(sizes) > 1.1 * sum(o.n_tokens for o in open_) / len(open_)
