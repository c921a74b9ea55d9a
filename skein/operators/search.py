"""Ranking of records by keywords, vectors and age."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import jstext
from skein.functions.jstext import FIELD_WEIGHTS, TYPE_WEIGHT
from skein.runtime import cut

#: The parts of a hybrid score, with and without vectors.
SEMANTIC, KEYWORD, RECENCY = 0.55, 0.30, 0.15
KEYWORD_ONLY = 0.85
LEAST_SEMANTIC = 0.3
BLANKS = re.compile(f"{jstext.WS}+")


def words_of(spark, query: str) -> list[str]:
    """The search words of a query."""
    return spark.range(1).select(jstext.keywords(F.lit(query)).alias("w")).first().w


def cosine(a: str, b: str):
    """Cosine similarity of two vector columns: 0 for unequal lengths, empty and zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def vector_top(entries: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, similarity): the k entries nearest to a query vector; ties by id."""
    vector = F.array(*(F.lit(float(x)) for x in query))
    scored = entries.withColumn("__q", vector).select("id", cosine("vector", "__q").alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


def active(df: DataFrame) -> DataFrame:
    """Records that are not resolved."""
    return df.where(F.coalesce("status", F.lit("active")) != "resolved")


def hybrid(memories: DataFrame, words: list[str], as_of: str, similarities: DataFrame | None = None, limit: int = 10, key: str = "mem_no") -> DataFrame:
    """(key, score, semantic, keyword, recency): active records by hybrid score; ties by key.

    similarities has (id, similarity) by memory id; scores are divided by their greatest, which
    one aggregate finds. Without any similarity above 0 keywords and age alone count. Records
    without a keyword hit stay only with a normal similarity above LEAST_SEMANTIC.
    """
    rows = active(memories).withColumn("kw", jstext.keyword_score(words)).withColumn("recency", jstext.recency(F.col("mem_date"), as_of))
    rows = rows.select(key, "kw", "recency", jstext.memory_id(F.col("mem_type"), F.col("title"), F.col("mem_date")).alias("__id"))
    if similarities is not None:
        rows = rows.join(similarities.select(F.col("id").alias("__id"), "similarity"), "__id", "left").withColumn("sem", F.coalesce("similarity", F.lit(0.0)))
    else:
        rows = rows.withColumn("sem", F.lit(0.0))
    top = rows.agg(F.greatest(F.max("kw"), F.lit(0.0)).alias("kw_top"), F.greatest(F.max("sem"), F.lit(0.0)).alias("sem_top")).first()
    share = lambda c, m: F.col(c) / m if m else F.lit(0.0)
    rows = rows.select(key, share("sem", top.sem_top).alias("semantic"), share("kw", top.kw_top).alias("keyword"), "recency", "kw")
    score = SEMANTIC * F.col("semantic") + KEYWORD * F.col("keyword") + RECENCY * F.col("recency") if top.sem_top else KEYWORD_ONLY * F.col("keyword") + RECENCY * F.col("recency")
    kept = rows.where((F.col("kw") > 0) | (F.col("semantic") > LEAST_SEMANTIC))
    return kept.select(key, score.alias("score"), "semantic", "keyword", "recency").orderBy(F.desc("score"), key).limit(limit)


def many_vector_top(queries: DataFrame, entries: DataFrame, k: int, rows_a_block: int = 4_000, queries_a_block: int = 500) -> DataFrame:
    """(query, id, similarity): the k entries most similar to each query vector, itself not counted; ties by id.

    Both tables have (id, vector). Blocks of queries meet blocks of entries in tasks of their own;
    a task gives k rows a query, so no list of all pairs exists. Vectors of another length, and
    null and zero vectors, are no neighbours.
    """
    import numpy as np
    import pandas as pd

    def spread(df: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
        blocks = max(1, -(-df.count() // rows))
        return df.select("id", F.transform("vector", lambda x: x.cast("double")).alias("v"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias(name)).where("v is not null"), blocks

    (q, n_q), (c, n_c) = spread(queries, queries_a_block, "qb"), spread(entries, rows_a_block, "cb")
    numbers = lambda n, name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(name)
    q = q.select("id", "v", "qb", numbers(n_c, "cb"))
    c = c.select("id", "v", "cb", numbers(n_q, "qb"))

    def best(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, part in qs.groupby(qs["v"].map(len)):
            own = cs[cs["v"].map(len) == size].sort_values("id")
            if not size or own.empty:
                continue
            x, y = np.stack(part["v"].to_numpy()), np.stack(own["v"].to_numpy())
            nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
            part, x, nx = part[nx > 0], x[nx > 0], nx[nx > 0]
            own, y, ny = own[ny > 0], y[ny > 0], ny[ny > 0]
            ids = own["id"].to_numpy()
            for name, row, norm in zip(part["id"], x, nx):
                s = np.round(y @ row / (ny * norm), 10)
                order = np.argsort(-s, kind="stable")[: k + 1]
                out += [(name, ids[j], float(s[j])) for j in order if ids[j] != name][:k]
        return pd.DataFrame(out, columns=["query", "id", "similarity"])

    own = lambda df: df.select("qb", "cb", "id", "v").groupBy("qb", "cb")
    found = own(q).cogroup(own(c)).applyInPandas(best, "query string, id string, similarity double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("__p", place).where(F.col("__p") <= k).drop("__p")


class WordFinder:
    """The words of a list that a text contains, each field as a bit of a word's mask.

    Words have no blank inside, so that one lies within one run of other characters; what is found
    in a run is kept for its next appearance.
    """

    KEPT_CHARS, KEPT_RUNS = 60, 200_000

    def __init__(self, words: list[str]):
        self.numbers = {w: i for i, w in enumerate(words)}
        self.lengths: dict[str, list[int]] = {}
        for n, start in sorted({(len(w), w[:2]) for w in words}):
            self.lengths.setdefault(start, []).append(n)
        self.runs: dict[str, tuple[int, ...]] = {}

    def in_run(self, run: str) -> tuple[int, ...]:
        found = self.runs.get(run)
        if found is None:
            hits = set()
            for i in range(len(run)):
                for start in {run[i], run[i : i + 2]}:
                    for n in self.lengths.get(start, ()):
                        hits.add(self.numbers.get(run[i : i + n], -1))
            found = tuple(hits - {-1})
            if len(run) <= self.KEPT_CHARS:
                if len(self.runs) >= self.KEPT_RUNS:
                    self.runs.clear()
                self.runs[run] = found
        return found

    def masks(self, texts: tuple[str, ...]) -> list[int]:
        """word number * 64 + mask of every word that one of at most 6 texts contains."""
        out: dict[int, int] = {}
        for bit, text in enumerate(texts):
            for run in set(BLANKS.split(text)):
                for w in self.in_run(run):
                    out[w] = out.get(w, 0) | 1 << bit
        return [w << 6 | mask for w, mask in out.items()]


def points_of_masks() -> np.ndarray:
    """[bonus, mask]: the points of a word found in the fields of a mask, for words of 1, 2 and more characters, added in the fields' order after the type's."""
    out = np.zeros((3, 64))
    for b, bonus in enumerate((1.0, 1.2, 2.0)):
        for mask in range(64):
            total = TYPE_WEIGHT if mask >> len(FIELD_WEIGHTS) & 1 else 0.0
            for bit, weight in enumerate(FIELD_WEIGHTS.values()):
                total += weight * bonus if mask >> bit & 1 else 0.0
            out[b, mask] = total
    return out


def many_keyword_top(queries: DataFrame, memories: DataFrame, as_of: str, k: int, key: str = "mem_no") -> DataFrame:
    """(query, key, score, keyword): the k best active records by keywords and age for each query (query, text); ties by key.

    Keyword scores are divided by the greatest of their query; records without a keyword are left
    out. The queries and their words go to every task. A record is searched once for all words,
    and its hits are kept; one pass over them finds the greatest score of each query, a second one
    the k best of each task. Time grows with queries times records, by one addition for each hit of a query's word.
    """
    named: dict = {}
    for r in queries.select("query", jstext.keywords(F.col("text")).alias("words")).collect():
        named.setdefault(r.query, []).extend(r.words)
    ids = [q for q, words in named.items() if words]
    words = sorted({w for q in ids for w in named[q]})
    number = {w: i for i, w in enumerate(words)}
    asked = [[number[w] for w in named[q]] for q in ids]
    sc = memories.sparkSession.sparkContext
    shared, wanted = sc.broadcast(words), sc.broadcast(asked)
    fields = [*FIELD_WEIGHTS, "mem_type"]
    kind = memories.schema[key].dataType.simpleString()
    whole = kind.endswith("int")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = WordFinder(shared.value)
        for batch in batches:
            batch["hits"] = [finder.masks(texts) for texts in zip(*(batch[f"l_{c}"] for c in fields))]
            yield batch[["key", "recency", "hits"]]

    lowered = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"l_{c}")
    rows = active(memories).select(F.col(key).alias("key"), jstext.recency(F.col("mem_date"), as_of).alias("recency"), *(lowered(c) for c in fields))
    hits = cut(rows.mapInPandas(search, f"key {kind}, recency double, hits array<int>").where(F.size("hits") > 0))

    def scores(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, keyword scores) of a batch's rows with a keyword of the query."""
        table = points_of_masks()
        bonus = np.array([min(len(w), 3) - 1 for w in shared.value])
        at = np.repeat(np.arange(len(batch)), batch["hits"].map(len).to_numpy())
        codes = np.concatenate(batch["hits"].to_numpy())
        codes, at = codes[order := np.argsort(codes >> 6, kind="stable")], at[order]
        found = codes >> 6
        points = table[bonus[found], codes & 63]
        ends = np.searchsorted(found, np.arange(len(bonus)), "right").tolist()
        for q, own in enumerate(wanted.value):
            spans = [slice(ends[w - 1] if w else 0, ends[w]) for w in own]
            rows = np.concatenate([at[s] for s in spans])
            if len(rows):
                # added word by word in the order of the query, as one record's score is
                kw = np.bincount(rows, np.concatenate([points[s] for s in spans]), len(batch))
                rows = np.flatnonzero(kw > 0)
                yield q, rows, kw[rows]

    def greatest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = np.zeros(len(wanted.value))
        for batch in batches:
            for q, _, kw in scores(batch) if len(batch) else ():
                top[q] = max(top[q], kw.max())
        yield pd.DataFrame({"q": np.flatnonzero(top), "top": top[top > 0]})

    tops = np.zeros(len(ids))
    for r in hits.select("hits").mapInPandas(greatest, "q bigint, top double").groupBy("q").agg(F.max("top").alias("top")).collect():
        tops[r.q] = r.top
    most = sc.broadcast(tops)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, list] = {}
        for batch in batches:
            if not len(batch):
                continue
            keys, recency = batch["key"], batch["recency"].to_numpy()
            # the place of each key among the batch's, null first
            place = keys.rank(method="min", na_option="top").to_numpy()
            holes = keys.isna().to_numpy()
            keys = [None if hole else int(v) if whole else v for v, hole in zip(keys, holes)] if holes.any() else keys.tolist()
            for q, rows, kw in scores(batch):
                keyword = kw / most.value[q]
                score = KEYWORD_ONLY * keyword + RECENCY * recency[rows]
                had = kept.get(q, [])
                edge = max(np.partition(score, -k)[-k] if len(rows) > k else -1.0, -had[-1][0] if len(had) >= k else -1.0)
                near = np.flatnonzero(score >= edge)
                if len(near) > k:
                    near = near[np.lexsort((place[rows[near]], -score[near]))[:k]]
                if len(near):
                    new = [(-s, keys[r] is not None, keys[r], w) for s, r, w in zip(score[near].tolist(), rows[near].tolist(), keyword[near].tolist())]
                    kept[q] = sorted(had + new, key=lambda x: x[:3] if x[1] else x[:2])[:k]
        flat = [(q, key, -s, w) for q, rows in kept.items() for s, _, key, w in rows]
        for i in range(0, len(flat), 10_000):
            yield pd.DataFrame(flat[i : i + 10_000], columns=["q", "key", "score", "keyword"]).astype({"key": object})

    found = hits.mapInPandas(best, f"q int, key {kind}, score double, keyword double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))
    names = memories.sparkSession.createDataFrame(list(enumerate(ids)), f"q int, query {queries.schema['query'].dataType.simpleString()}")
    return found.withColumn("__p", place).where(F.col("__p") <= k).join(names, "q").select("query", F.col("key").alias(key), "score", "keyword")
