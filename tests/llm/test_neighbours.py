import numpy as np

from skein.llm import neighbours

SCHEMA = "id string, vector array<float>, model string, dimension int, v string, parts string"


def entries(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], m, d, None, None) for i, v, m, d in rows], SCHEMA)


def brute(rows, k, least):
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    out = set()
    for i in range(len(ids)):
        for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 12), ids[j]))[:k]:
            if s[i, j] >= least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    return [(f"{i:05d}", centres[i % len(centres)] * rng.uniform(0.5, 3) + 0.15 * rng.standard_normal(dim), "m", dim) for i in range(n)]


def pairs(df):
    return {(r.id_a, r.id_b) for r in df.collect()}


def test_recall(spark):
    rows = clustered(1200, 32, 3)
    want, got = brute(rows, 5, 0.9), pairs(neighbours.similar_pairs(entries(spark, rows)))
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)


def test_crowded_buckets_are_searched_in_blocks(spark, monkeypatch):
    rows = clustered(300, 16, 5)
    monkeypatch.setattr(neighbours, "CROWDED", 3)
    want, got = brute(rows, 5, 0.9), pairs(neighbours.similar_pairs(entries(spark, rows)))
    assert len(want & got) >= 0.95 * len(want)


def test_unsound_rows_ties_and_copies(spark):
    same = [1, 2, 3, 4]
    rows = [(f"c{i}", same, "m", 4) for i in range(9)] + [("far", [-1, 2, -3, 4], "m", 4), ("c0", same, "m", 4), ("other", same, "n", 4)]
    rows += [("n", None, "m", 4), ("z", [0, 0, 0, 0], "m", 4), ("s", [1, 2, 3], "m", 4), ("f", [1, 2, 3, float("inf")], "m", 4), ("nan", [1, 2, 3, float("nan")], "m", 4), ("hole", [1, None, 3, 4], "m", 4), (None, same, "m", 4), ("nomodel", same, None, 4)]
    got = pairs(neighbours.similar_pairs(entries(spark, rows)))
    # of equal vectors the 5 lowest ids are the nearest
    want = {(min(a, b), max(a, b)) for a in (f"c{i}" for i in range(9)) for b in [c for c in (f"c{i}" for i in range(9)) if c != a][:5]}
    assert got == want


def test_empty_and_single(spark):
    assert pairs(neighbours.similar_pairs(entries(spark, [("a", [1, 2], "m", 2)]).limit(0))) == set()
    assert pairs(neighbours.similar_pairs(entries(spark, [("a", [1, 2], "m", 2)]))) == set()


def test_nearest_gives_every_vector_its_k_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(f"{i:05d}", rng.standard_normal(48), "m", 48) for i in range(500)] + [(f"t{i}", rng.standard_normal(8), "n", 8) for i in range(3)]
    rows += [(f"{i:05d}", 2 * rows[i - 500][1], "m", 48) for i in range(500, 510)]
    got = {}
    for r in neighbours.nearest(entries(spark, rows)).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.other)
    for of in (rows[:500] + rows[503:], rows[500:503]):
        ids, x = [r[0] for r in of], np.array([r[1] for r in of], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        s = np.round(x @ x.T, 10)
        for i in range(len(ids)):
            assert got[ids[i]] == [ids[j] for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:5]]


def test_exact_search_over_many_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((90, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1:7] = x[0]
    coded = spark.createDataFrame([("m", f"{i:03d}", [float(v) for v in x[i]]) for i in range(90)], "model string, id string, v array<double>")
    got = {(r.id, r.other) for r in neighbours.exact(coded.where("id < '040'").select("model", "id"), coded, 5, 20, 7).collect()}
    s = np.round(x @ x.T, 10)
    assert got == {(f"{i:03d}", f"{j:03d}") for i in range(40) for j in sorted((j for j in range(90) if j != i), key=lambda j: (-s[i, j], j))[:5]}
