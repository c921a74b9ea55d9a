"""The most similar vectors of every vector, by multi-index hashing.

Vectors of a model become unit vectors; equal ones form a class that is searched once. A rotation
learned from a bounded sample (principal axes mixed by a random orthogonal matrix) turns a vector
into binary codes of 8 parts. Parts are paired around a ring of 8 tables; a table is keyed by both
parts of its pair. A search probes the codes within one bit of both parts, so that two vectors meet
in a table exactly once if both parts differ by at most one bit. By the pigeonhole principle every
pair of codes within a small Hamming radius meets somewhere. Pairs that meet are filtered by their
whole codes and reranked by the floats.

Vectors and codes are written once to the shared folder. Every task reads them slice by slice,
builds the tables of a slice in memory and looks its own vectors up there, so that neither probes
nor pairs are ever shuffled.

Codes find nearly all pairs of at least SURE, few of those further apart. A vector whose k
neighbours by codes do not all reach SURE is therefore searched exactly, against every vector of
its model, in blocks; only a search for pairs of at least SURE goes without that.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.runtime import cut, shared_dir

PARTS = 8
#: Vectors per model that the rotation is learned from.
SAMPLE = 10_000
#: Codes further apart than this share of their bits are no candidates (0.9 is about 0.14 on average).
RADIUS = 0.33
#: Codes find nearly every pair of at least this similarity.
SURE = 0.9
#: Buckets with more members than this are searched in blocks instead of by pairs.
CROWDED = 2_000
#: Vectors whose tables a task holds at once, files they are kept in at least, rows and pairs that are looked up at once.
SLICE, FILES, ROWS_A_STEP, PAIRS_A_STEP = 250_000, 24, 2_000, 1_000_000


def usable_vectors(entries: DataFrame) -> DataFrame:
    """(model, id, vector, norm): one vector per id and model; divided by its norm it is a unit vector.

    Vectors that are null, not of `dimension` numbers, not finite or all zero, and rows without
    id, model or dimension, do not take part. Of repeated rows of an id the smallest vector counts.
    """
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = entries.where("id is not null and model is not null and vector is not null and dimension > 0").where((F.size("vector") == F.col("dimension")) & sound)
    rows = rows.select("model", "id", "vector", norm.alias("norm")).where("norm > 0")
    one = rows.groupBy("model", "id").agg(F.min(F.struct("vector", "norm")).alias("r"))
    return one.select("model", "id", "r.vector", "r.norm")


def unit():
    """The unit vector of (vector, norm)."""
    return F.transform("vector", lambda x: x.cast("double") / F.col("norm"))


def rotations(vectors: DataFrame, bits: int, seed: int = 7) -> dict[str, np.ndarray]:
    """model -> directions as rows, learned from at most SAMPLE vectors of each model.

    Directions go through the origin, so that the bits in which two codes differ follow the
    angle between the vectors whatever the sample's mean is. The sample takes the vectors with the smallest hashes of their ids, so it is the same on every run.
    """
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.xxhash64("id"), "id"))
    # only ids are ranked, and only vectors up to the last hash of a sample are moved
    last = vectors.select("model", "id").withColumn("__r", place).where(F.col("__r") <= SAMPLE).groupBy("model").agg(F.max(F.xxhash64("id")).alias("__last"))
    few = vectors.join(F.broadcast(last), "model").where(F.xxhash64("id") <= F.col("__last")).select("model", "id", unit().alias("v"))
    ranked = few.withColumn("__r", place)
    schema = "model string, axes array<array<double>>"

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["v"].to_numpy()).astype(np.float64)
        mean = x.mean(axis=0)
        rng = np.random.default_rng(seed)
        dim = x.shape[1]
        _, axes = np.linalg.eigh(np.cov((x - mean).T).reshape(dim, dim) + 1e-9 * np.eye(dim)) if len(x) > 1 else (None, np.eye(dim))
        rows = []
        while len(rows) < bits:
            mixed, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
            rows += list(mixed @ axes.T)
        return pd.DataFrame([(group["model"].iloc[0], [r.tolist() for r in rows[:bits]])], columns=["model", "axes"])

    rows = ranked.where(F.col("__r") <= SAMPLE).select("model", "v").groupBy("model").applyInPandas(learn, schema).collect()
    return {r.model: np.array(r.axes) for r in rows}


def with_codes(vectors: DataFrame, learned: dict, part_bits: int) -> DataFrame:
    """(nr, model, id, vector, norm, parts): vectors with a number and the 8 parts of their codes as integers."""
    shared = vectors.sparkSession.sparkContext.broadcast(learned)
    weights = 2 ** np.arange(part_bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = np.zeros((len(batch), PARTS), dtype=np.int32)
            for model, rows in batch.groupby("model").indices.items():
                axes = shared.value[model]
                x = np.stack(batch["vector"].to_numpy()[rows]).astype(np.float64) / batch["norm"].to_numpy()[rows][:, None]
                parts[rows] = (x @ axes.T > 0).reshape(len(rows), PARTS, part_bits) @ weights
            batch["parts"] = list(parts)
            yield batch

    numbered = vectors.select(F.monotonically_increasing_id().alias("nr"), "model", "id", "vector", "norm")
    return numbered.mapInPandas(run, "nr bigint, model string, id string, vector array<float>, norm double, parts array<int>")


class Coded:
    """Vectors of one model with their codes, as arrays."""

    def __init__(self, rows: pd.DataFrame, part_bits: int):
        self.nr, self.id, self.norm = rows["nr"].to_numpy(), rows["id"].to_numpy(), rows["norm"].to_numpy()
        self.x = np.stack(rows["vector"].to_numpy()).astype(np.float32)
        self.parts = np.stack(rows["parts"].to_numpy()).astype(np.int64)
        packed = lambda first: sum(self.parts[:, first + n] << (n * part_bits) for n in range(PARTS // 2))
        self.low, self.high = packed(0), packed(PARTS // 2)

    def units(self, rows: np.ndarray) -> np.ndarray:
        return self.x[rows].astype(np.float64) / self.norm[rows][:, None]


def similarities(own: Coded, other: Coded, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The rounded similarities of rows r of own and c of other."""
    return np.round(np.concatenate([np.einsum("ij,ij->i", own.units(r[i : i + 50_000]), other.units(c[i : i + 50_000])) for i in range(0, len(r), 50_000)] or [np.zeros(0)]), 10)


def crowd(own: Coded, other: Coded, probing: np.ndarray, members: np.ndarray, k: int, rows_a_step: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(r, c): the k most similar members of one bucket for each probing row, compared as matrices of 4,000 members at most."""
    r, c = [], []
    for lo in range(0, len(members), 4_000):
        part = members[lo : lo + 4_000]
        y = other.units(part).T
        for i in range(0, len(probing), rows_a_step):
            rows = probing[i : i + rows_a_step]
            s = own.units(rows) @ y
            s[own.nr[rows][:, None] == other.nr[part][None, :]] = -2
            m = min(k, len(part))
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            r.append(np.repeat(rows, m))
            c.append(part[top].ravel())
    r, c = np.concatenate(r), np.concatenate(c)
    keep = own.nr[r] != other.nr[c]
    return r[keep], c[keep]


def meetings(own: Coded, other: Coded, part_bits: int, k: int, crowded: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(r, c), in steps: rows of own and other vectors that meet in a table and whose codes are close; a pair may come again only from crowded buckets."""
    flips = np.concatenate([[0], 1 << np.arange(part_bits)])
    both = ((flips[:, None] << part_bits) ^ flips[None, :]).ravel()
    far = int(RADIUS * PARTS * part_bits)
    one_bit = lambda r, c, t: np.bitwise_count(own.parts[r, t % PARTS] ^ other.parts[c, t % PARTS]) <= 1
    for t in range(PARTS):
        key = lambda of: (of.parts[:, t] << part_bits) | of.parts[:, (t + 1) % PARTS]  # noqa: E731, B023
        theirs, mine = key(other), key(own)
        order = np.argsort(theirs, kind="stable")
        counts = np.bincount(theirs, minlength=1 << 2 * part_bits)
        starts = np.cumsum(counts) - counts
        for lo in range(0, len(mine), ROWS_A_STEP):
            probed = (mine[lo : lo + ROWS_A_STEP, None] ^ both[None, :]).ravel()
            n = counts[probed]
            rows = lo + np.flatnonzero(n) // len(both)
            probed, n = probed[n > 0], n[n > 0]
            full = n > crowded
            for bucket in np.unique(probed[full]):
                yield crowd(own, other, rows[probed == bucket], order[starts[bucket] : starts[bucket] + counts[bucket]], k)
            rows, probed, n = rows[~full], probed[~full], n[~full]
            ends = np.cumsum(n)
            bounds = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, PAIRS_A_STEP), "left").tolist() + [len(n)]
            for i, j in zip(bounds, bounds[1:]):
                r = np.repeat(rows[i:j], n[i:j])
                c = order[np.arange(len(r)) + np.repeat(starts[probed[i:j]] - (ends[i:j] - n[i:j] - (ends[i] - n[i] if j > i else 0)), n[i:j])]
                near = np.bitwise_count(own.low[r] ^ other.low[c]) + np.bitwise_count(own.high[r] ^ other.high[c]) <= far
                r, c = r[near], c[near]
                new = own.nr[r] != other.nr[c]
                for u in range(t):
                    new &= ~(one_bit(r, c, u) & one_bit(r, c, u + 1))
                yield r[new], c[new]


def best_of(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k most similar rows (r, other, s) of each r, each once, ties by the smaller other."""
    ranked = found.drop_duplicates(["r", "other"]).sort_values(["r", "s", "other"], ascending=[True, False, True], kind="stable")
    return ranked[ranked.groupby("r").cumcount() < k]


def by_codes(coded: DataFrame, folder: str, slices: list[list[str]], part_bits: int, k: int, least: float | None) -> DataFrame:
    """(model, id, other, similarity, rank): the k most similar of the vectors that codes bring together, ties by the smaller id.

    A task holds its own vectors and one slice of all vectors, read from the shared folder.
    """
    crowded = CROWDED

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs, parquet

        mine = pd.concat([pd.DataFrame({"model": [], "nr": []}), *batches])
        if not len(mine):
            return
        system, root = fs.FileSystem.from_uri(folder)
        own = {model: Coded(rows, part_bits) for model, rows in mine.groupby("model")}
        kept = {model: pd.DataFrame({"r": [], "other": [], "s": []}) for model in own}
        for files in slices:
            whole = pd.concat([parquet.read_table(f"{root}/{f}", filesystem=system, partitioning=None).to_pandas() for f in files])
            for model, rows in whole.groupby("model"):
                if model not in own:
                    continue
                x, y = own[model], Coded(rows, part_bits)
                out, size = [kept[model]], 0
                for r, c in meetings(x, y, part_bits, k, crowded):
                    s = similarities(x, y, r, c)
                    good = s >= (-2 if least is None else least)
                    out.append(pd.DataFrame({"r": r[good], "other": y.id[c[good]], "s": s[good]}))
                    size += len(out[-1])
                    if size > PAIRS_A_STEP:
                        out, size = [best_of(pd.concat([o for o in out if len(o)]), k)], 0
                filled = [o for o in out if len(o)]
                if filled:
                    kept[model] = best_of(pd.concat(filled), k)
        for model, rows in ((m, rows) for m, rows in kept.items() if len(rows)):
            yield pd.DataFrame({"model": model, "id": own[model].id[rows["r"].to_numpy().astype(np.int64)], "other": rows["other"].to_numpy(), "similarity": rows["s"].to_numpy(), "rank": rows.groupby("r").cumcount().to_numpy() + 1})

    return coded.select("nr", "model", "id", "vector", "norm", "parts").mapInPandas(search, "model string, id string, other string, similarity double, rank int")


def written(coded: DataFrame, n: int) -> tuple[str, list[list[str]]]:
    """A new folder in the shared folder with the n rows of coded, and its files' names in slices of about SLICE rows."""
    spark = coded.sparkSession
    folder = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    coded.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if s.getPath().getName().endswith(".parquet"))
    each = max(1, len(names) * SLICE // max(n, 1))
    return folder, [names[i : i + each] for i in range(0, len(names), each)]


def dropped(spark, folder: str) -> None:
    """Remove a folder of written()."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exact(open_ids: DataFrame, coded: DataFrame, k: int, rows_a_block: int = 4_000, rows_a_step: int = 250) -> DataFrame:
    """(model, id, other, similarity): the k most similar vectors of each of open_ids (model, id), ties by the smaller id.

    Every block of open vectors meets every block of the model's vectors in a task of its own; a
    task holds two blocks and the similarities of rows_a_step rows, and gives k rows per vector.
    """
    vectors = coded.select("model", "id", "v")

    def spread(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        sizes = df.groupBy("model").agg(F.ceil(F.count("*") / rows_a_block).alias(f"n_{name}"))
        return df.join(sizes, "model").withColumn(name, F.pmod(F.xxhash64("id"), F.col(f"n_{name}"))).drop(f"n_{name}"), sizes

    (q, n_q), (c, n_c) = spread(vectors.join(open_ids, ["model", "id"], "left_semi"), "qb"), spread(vectors, "cb")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    keys = ["model", "qb", "cb"]
    q = q.join(n_c, "model").withColumn("cb", every("n_cb")).select(*keys, "id", "v")
    c = c.join(n_q, "model").withColumn("qb", every("n_qb")).select(*keys, "id", "v")

    def best(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"model": [], "id": [], "other": [], "s": []})]
        if len(qs) and len(cs):
            cs = cs.sort_values("id")
            x, y = np.stack(qs["v"].to_numpy()), np.stack(cs["v"].to_numpy())
            ids_q, ids_c = qs["id"].to_numpy(), cs["id"].to_numpy()
            place = {v: i for i, v in enumerate(ids_c)}
            m = min(k + 1, len(y))
            for i in range(0, len(x), rows_a_step):
                s = np.round(x[i : i + rows_a_step] @ y.T, 10)
                own = [(r, place[v]) for r, v in enumerate(ids_q[i : i + rows_a_step]) if v in place]
                if own:
                    s[tuple(np.array(own).T)] = -2
                edge = np.partition(s, -m, axis=1)[:, -m]
                r, j = np.nonzero((s >= edge[:, None]) & (s > -2))
                order = np.lexsort((j, -s[r, j], r))
                r, j = r[order], j[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, j = r[keep], j[keep]
                out.append(pd.DataFrame({"model": qs["model"].iloc[0], "id": ids_q[i + r], "other": ids_c[j], "s": s[r, j]}))
        return pd.concat(out[1:] or out)

    own = lambda df: df.select(*(F.col(x).alias(x) for x in [*keys, "id", "v"])).groupBy(*keys)
    found = own(q).cogroup(own(c)).applyInPandas(best, "model string, id string, other string, s double")
    ranked = found.withColumn("__r", F.row_number().over(Window.partitionBy("model", "id").orderBy(F.desc("s"), "other")))
    return ranked.where(F.col("__r") <= k).select("model", "id", "other", F.col("s").alias("similarity"))


def nearest(entries: DataFrame, k: int = 5, least: float | None = None) -> DataFrame:
    """(model, id, other, similarity, rank): the k most similar other ids of every usable id of a model.

    Similarities are rounded to ten digits; ties are broken by the smaller id. With `least`, neighbours below that cosine similarity are
    left out; with `least` below SURE or none, vectors that the codes leave without k neighbours of
    at least SURE are searched exactly. Ids with equal vectors are each other's neighbours at similarity 1; such a class is
    searched once, through its smallest id, and expanded by at most k + 1 ids per class.
    """
    spark = entries.sparkSession
    text = F.array_join(F.transform(unit(), lambda x: x.cast("string")), ",")
    keyed = cut(usable_vectors(entries).withColumn("cls", F.md5(text)))
    within = Window.partitionBy("model", "cls").orderBy("id")
    firsts = keyed.select("model", "cls", "id").withColumn("place", F.row_number().over(within)).where(F.col("place") <= k + 1)
    heads = keyed.groupBy("model", "cls").agg(F.min("id").alias("id"))
    n = heads.count()
    if not n:
        return spark.createDataFrame([], "model string, id string, other string, similarity double, rank int")
    part_bits = min(15, max(4, math.ceil(math.log2(max(min(n, SLICE), 2)) / 2)))
    one = keyed.join(heads.select("model", "id"), ["model", "id"], "left_semi").select("model", "id", "vector", "norm")
    one = one.repartition(max(FILES, -(-n // (SLICE // 10))), "id")
    folder, slices = written(with_codes(one, rotations(one, PARTS * part_bits), part_bits), n)
    files = spark.read.parquet(folder)
    best = Window.partitionBy("model", "id").orderBy(F.desc("similarity"), "other")
    top = cut(by_codes(files, folder, slices, part_bits, k, least))
    if least is None or least < SURE:
        coded = files.select("model", "id", unit().alias("v"))
        copies_of = keyed.groupBy("model", "cls").agg(F.min("id").alias("id"), (F.count("*") - 1).alias("n")).select("model", "id", "n")
        hits = top.where(F.col("similarity") >= SURE).groupBy("model", "id").agg(F.count("*").alias("n"))
        sure = hits.unionByName(copies_of).groupBy("model", "id").agg(F.sum("n").alias("n")).where(F.col("n") >= k)
        unsure = cut(coded.select("model", "id").join(sure, ["model", "id"], "left_anti"))
        whole = exact(unsure, coded, k).where(F.col("similarity") >= (-2 if least is None else least)).withColumn("rank", F.row_number().over(best))
        top = cut(top.join(unsure, ["model", "id"], "left_anti").unionByName(whole))
    dropped(spark, folder)
    head_of = heads.select("model", F.col("id").alias("head"), "cls")
    members = keyed.select("model", "id", "cls").join(head_of, ["model", "cls"])
    other_ids = firsts.join(head_of, ["model", "cls"]).select("model", F.col("head").alias("other_head"), F.col("id").alias("other"), "place")
    copies = firsts.groupBy("model", "cls").agg(F.max("place").alias("m")).where("m > 1")
    same = members.join(copies, ["model", "cls"]).join(firsts.select("model", "cls", F.col("id").alias("other")), ["model", "cls"]).where("id <> other").select("model", "id", "other", F.lit(1.0).alias("similarity"))
    across = members.join(top.select("model", F.col("id").alias("head"), F.col("other").alias("other_head"), "similarity"), ["model", "head"])
    across = across.join(other_ids.where(F.col("place") <= k), ["model", "other_head"]).select("model", "id", "other", "similarity")
    every = same.unionByName(across)
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def similar_pairs(entries: DataFrame, k: int = 5, least: float = 0.9) -> DataFrame:
    """(id_a, id_b), id_a < id_b: ids of one model with similarity of at least `least`, one among the k most similar of the other."""
    found = nearest(entries, k, least)
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
