"""Records linked to the commits that implement them, by weighted token similarity."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import jstext
from skein.runtime import cut

#: Scores above the first link at once, above the second are suggested.
AUTO, SUGGEST = 0.70, 0.40
#: The fewest and the most bags of a block, and the blocks that the left side has while they are not too large.
LEAST_ROWS, MOST_ROWS, BLOCKS = 2_000, 100_000, 6
#: The most rows of one part of a class of equal bags, the pairs that a batch of results has, and the paths of a link whose commit has none that the record names.
MEMBERS, BATCH, FIRST = 100, 50_000, 5
#: A token of one in so many bags of a block has a number for each of them, as far as all these take so many bytes.
DENSE, DENSE_BYTES = 40, 96_000_000


def bag(df: DataFrame, key: str, fields: list[tuple]) -> DataFrame:
    """(id, token, w): the tokens of each row, every field's distinct tokens with its weight, weights added up.

    fields are (column, weight); an array column counts every element as a field of its own.
    """
    parts = []
    for column, weight, is_array in fields:
        rows = df.select(F.col(key).alias("id"), F.explode(column).alias("t")) if is_array else df.select(F.col(key).alias("id"), column.alias("t"))
        parts.append(rows.select("id", F.explode(jstext.keywords(F.col("t"))).alias("token"), F.lit(weight).alias("w")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("id", "token").agg(F.sum("w").cast("bigint").alias("w"))


def spaced(path) -> F.Column:
    """A path with blanks between its parts."""
    return F.regexp_replace(path, r"[/\\._-]", " ")


def memory_bag(memories: DataFrame) -> DataFrame:
    """Title three times, type twice, the first 500 characters of the content once."""
    return bag(memories, "mem_no", [(F.col("title"), 3, False), (F.col("mem_type"), 2, False), (F.substring("content", 1, 500), 1, False)])


def commit_bag(commits: DataFrame) -> DataFrame:
    """Subject three times, every path twice, the first 500 characters of the body and the author once."""
    paths = F.transform("paths", spaced)
    return bag(commits, "commit_no", [(F.col("subject"), 3, False), (paths, 2, True), (F.substring("body", 1, 500), 1, False), (F.col("author"), 1, False)])


def bag_rows(bags: DataFrame) -> DataFrame:
    """(id, total, bag) of every id, bag being its (token, w) pairs in order. It has the words of a title and the first characters of a text, so a row stays small."""
    return bags.where("id is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("token", "w"))).alias("bag"), F.sum("w").alias("total"))


def bag_classes(rows: DataFrame) -> tuple[DataFrame, int]:
    """(rep, total, members, bag, paths) of every class of rows with equal bags and paths, and how many rows there are.

    rows are those of bag_rows, with paths or without; members has what else each row has, rep is
    the lowest id. A class of more than MEMBERS rows comes in several parts.
    """
    same = [c for c in ("bag", "paths") if c in rows.columns]
    keyed = cut(rows.withColumn("digest", F.md5(F.to_json(F.struct(*same)))))
    large = keyed.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > MEMBERS)
    part = F.pmod(F.xxhash64("id"), F.coalesce(F.ceil(F.col("n") / MEMBERS), F.lit(1)))
    parts = keyed.join(large, "digest", "left").groupBy("digest", part.alias("part"))
    one = F.struct(*(c for c in rows.columns if c not in {"total", *same}))
    classes = parts.agg(F.min("id").alias("rep"), F.first("total").alias("total"), F.collect_list(one).alias("members"), *(F.first(c).alias(c) for c in same))
    return classes.drop("digest", "part"), keyed.count()


def column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The lengths of lists, and what they hold, one after the other."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def shared_weights(total_x: np.ndarray, total_y: np.ndarray, xs: tuple, ys: tuple, least: float) -> tuple[np.ndarray, ...]:
    """(r, c, low): rows r of xs and c of ys (row, token, weight) whose similarity can be `least`, low being the weight that they share.

    A row of xs adds up, for all of ys at once, what each of its tokens gives: by a list of the
    rows that have the token, or where these are many, by one number for every row.
    """
    (rx, tx, wx), (ry, ty, wy) = xs, ys
    order = np.argsort(ty, kind="stable")
    seen = np.bincount(ty, minlength=max(tx.max(initial=-1), ty.max(initial=-1)) + 1)
    ends = np.cumsum(seen)
    starts = ends - seen
    # tokens that ys do not have are nowhere to be found
    kept = seen[tx] > 0
    rx, tx, wx = rx[kept], tx[kept], wx[kept]
    by_row = np.argsort(rx, kind="stable")
    tx, wx, to = tx[by_row], wx[by_row], np.cumsum(np.bincount(rx, minlength=len(total_x)))
    own = np.cumsum(np.concatenate([[0], wx]))
    share = least / (1 + least)
    needed_y = total_y * share - 1e-9
    kind = np.int16 if max(total_x.max(initial=0), total_y.max(initial=0)) < 2**15 else np.int64
    rows, short = ry[order], -np.floor(needed_y).astype(kind)
    weights = {w: np.minimum(wy[order], w).astype(kind) for w in np.unique(wx).tolist()}
    near = np.zeros(-(-len(total_y) // 8) * 8, dtype=bool)
    many, whole = len(total_y) / DENSE, {}
    room = DENSE_BYTES // max(1, short.nbytes)
    out = [(np.zeros(0, dtype=np.int64),) * 3]
    for r in range(len(total_x)):
        lo, hi = int(to[r - 1]) if r else 0, int(to[r])
        if own[hi] - own[lo] < least * total_x[r]:
            continue
        got = short.copy()
        mine = tx[lo:hi]
        for t, w, i, j in zip(mine.tolist(), wx[lo:hi].tolist(), starts[mine].tolist(), ends[mine].tolist()):
            every = whole.get((t, w)) if j - i >= many else None
            if every is None:
                if j - i < many or len(whole) >= room:
                    got[rows[i:j]] += weights[w][i:j]
                    continue
                every = whole[t, w] = np.zeros(len(short), dtype=kind)
                every[rows[i:j]] = weights[w][i:j]
            got += every
        np.greater_equal(got, math.floor(share * total_x[r]), out=near[: len(got)])
        # few are near, so that eight are passed over at once
        c = (np.flatnonzero(near.view(np.int64))[:, None] * 8 + np.arange(8)).ravel()
        c = c[near[c]]
        low = got[c].astype(np.int64) - short[c]
        keep = (low > 0) & (low >= needed_y[c] + share * total_x[r])
        out.append((np.full(keep.sum(), r), c[keep], low[keep]))
    return tuple(np.concatenate(v) for v in zip(*out))


class Told:
    """The paths of the rows of a block (paths, told: the words of each), each distinct path looked up by its words."""

    def __init__(self, table: pa.Table, words: np.ndarray, lengths: np.ndarray, x: np.ndarray, tokens: np.ndarray):
        self.sizes, self.paths = flat(column(table, "paths"))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.names = numbers(self.paths.dictionary_encode(null_encoding="encode").indices)
        n = self.names.max(initial=-1) + 1
        words, self.by_word = np.divmod(np.unique(words * n + np.repeat(self.names, lengths)), max(n, 1))
        self.seen = np.bincount(words, minlength=tokens.max(initial=-1) + 1)
        self.ends = np.cumsum(self.seen)
        kept = self.seen[tokens] > 0
        self.tokens, self.to = tokens[kept], np.cumsum(np.bincount(x[kept], minlength=x.max(initial=-1) + 1))
        self.mark = np.zeros(n, dtype=bool)

    def shared(self, r: np.ndarray, c: np.ndarray) -> pa.Array:
        """For each pair of row r of the other side, which go up, and c: c's paths that share a word with r, else c's first ones."""
        sizes = self.sizes[c]
        at, of, until = spans(self.starts[c], sizes), np.repeat(np.arange(len(c)), sizes), np.cumsum(sizes)
        names, hit = self.names[at], np.zeros(len(at), dtype=bool)
        first = np.flatnonzero(np.diff(r, prepend=-1))
        for lo, hi, x in zip(first.tolist(), np.append(first[1:], len(r)).tolist(), r[first].tolist()):
            mine = self.tokens[self.to[x - 1] if x else 0 : self.to[x]].tolist()
            if mine:
                told = np.concatenate([self.by_word[self.ends[t] - self.seen[t] : self.ends[t]] for t in mine])
                span = slice(until[lo] - sizes[lo], until[hi - 1])
                self.mark[told] = True
                hit[span] = self.mark[names[span]]
                self.mark[told] = False
        hits = np.bincount(of[hit], minlength=len(c))
        hit |= (hits[of] == 0) & (np.arange(len(at)) - (until - sizes)[of] < FIRST)
        kept = np.cumsum(np.bincount(of[hit], minlength=len(c)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], kept]), pa.int32()), self.paths.take(pa.array(at[hit])))


def known_members(xs: pa.ListArray, ys: pa.ListArray) -> Callable:
    """A function of pairs (r, c) of rows of xs and ys, lists of members (known, sha), that gives the pairs of which members know each other, and (pair, a, b) of such pairs' other members."""
    (nx, mx), (ny, my) = flat(xs), flat(ys)
    sizes, known = flat(mx.field("known"))
    shas = numbers(pc.fill_null(pa.concat_arrays([known, my.field("sha")]).dictionary_encode().indices, -1))
    a = np.repeat(np.arange(len(mx)), sizes)
    mine = pd.DataFrame({"sha": shas[: len(known)], "a": a, "r": np.repeat(np.arange(len(nx)), nx)[a]})
    theirs = pd.DataFrame({"sha": shas[len(known) :], "b": np.arange(len(my)), "c": np.repeat(np.arange(len(ny)), ny)})
    met = mine[mine["sha"] >= 0].merge(theirs, on="sha")
    rows, members = np.unique(met["r"].to_numpy() * len(ny) + met["c"].to_numpy()), met["a"].to_numpy() * len(my) + met["b"].to_numpy()
    start_x, start_y = np.cumsum(nx) - nx, np.cumsum(ny) - ny

    def of(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        pair = np.flatnonzero(np.isin(r * len(ny) + c, rows))
        per = nx[r[pair]] * ny[c[pair]]
        at, k = np.repeat(pair, per), spans(np.zeros(len(per), dtype=np.int64), per)
        a, b = start_x[r[at]] + k // ny[c[at]], start_y[c[at]] + k % ny[c[at]]
        new = ~np.isin(a * len(my) + b, members)
        return pair, at[new], a[new], b[new]

    return of


def linked_rows(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, score, paths): pairs of rows of bag_rows whose weighted Jaccard similarity is at least `least`. Exact but for tokens of one 64-bit hash.

    If right has paths, so has the result: those that share a word with the left row, else the
    first five. Then left has known, and right sha: rows of a sha that the left row knows are no pairs.

    Equal bags are one class that is joined once. Every block of classes of the left side meets
    every block of the right side in a task of its own, so only bags are moved, once for every
    block they meet, and no list of the pairs that share a token exists. What a pair takes from its
    rows is in the block as well, so that no pair is moved. The time grows with the pairs that
    share one of their rarer tokens.
    """
    (lc, n_l), (rc, n_r) = bag_classes(left), bag_classes(right)
    blocks_of = lambda n, least_blocks: -(-n // min(MOST_ROWS, max(LEAST_ROWS, -(-n // least_blocks)))) or 1
    n_x, n_y = blocks_of(n_l, BLOCKS), blocks_of(n_r, 2)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int")
    hashes = lambda words: F.transform(words, lambda t: F.xxhash64(t))
    named = "paths" in rc.columns

    def spread(df: DataFrame, i, j):
        more = ["paths", F.transform("paths", lambda p: hashes(jstext.keywords(spaced(p)))).alias("told")] if named and "paths" in df.columns else []
        # a select with an explode would do all this once for every block
        rows = df.select("rep", "total", "members", hashes("bag.token").alias("tokens"), F.transform("bag.w", lambda w: w.cast("int")).alias("weights"), *more)
        return rows.select("*", i.alias("i")).select("*", j.alias("j")).repartition(min(400, 2 * n_x * n_y), "i", "j").groupBy("i", "j")

    def meet(xs: pa.Table, ys: pa.Table) -> pa.Table:
        (nx, tx), (ny, ty) = flat(column(xs, "tokens")), flat(column(ys, "tokens"))
        lengths, words = flat(flat(column(ys, "told"))[1]) if named else (nx[:0], ty[:0])
        codes = pd.factorize(np.concatenate([numbers(t) for t in (tx, ty, words)]))[0]
        codes_x, codes_y, words = np.split(codes, [len(tx), len(tx) + len(ty)])
        rx, ry = np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)
        weights = lambda t: numbers(flat(column(t, "weights"))[1])
        total_x, total_y = numbers(column(xs, "total")), numbers(column(ys, "total"))
        r, c, low = shared_weights(total_x, total_y, (rx, codes_x, weights(xs)), (ry, codes_y, weights(ys)), least)
        score = low / (total_x[r] + total_y[c] - low)
        r, c, score = (v[score >= least] for v in (r, c, score))
        of_x, of_y = column(xs, "members"), column(ys, "members")
        told, known = (Told(ys, words, lengths, rx, codes_x), known_members(of_x, of_y)) if named else (None, None)
        ids = lambda lists, of: pa.ListArray.from_arrays(lists.offsets, lists.values.field("id")).take(pa.array(of))
        alone = lambda lists, at: pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1), pa.int32()), flat(lists)[1].field("id").take(pa.array(at)))
        out = []
        for lo in range(0, max(1, len(r)), BATCH):
            x, y = r[lo : lo + BATCH], c[lo : lo + BATCH]
            found = pa.table({"a": ids(of_x, x), "b": ids(of_y, y), "score": pa.array(score[lo : lo + BATCH])})
            if named:
                found = found.append_column("paths", told.shared(x, y))
                pair, at, a, b = known(x, y)
                if len(pair):
                    others = found.take(pa.array(at))
                    others = pa.table({"a": alone(of_x, a), "b": alone(of_y, b), "score": others["score"], "paths": others["paths"]})
                    out.append(others.combine_chunks())
                    found = found.take(pa.array(np.delete(np.arange(len(x)), pair)))
            out.append(found)
        return pa.concat_tables(out)

    kind = lambda df: df.schema["rep"].dataType.simpleString()
    met = spread(lc, own(n_x), every(n_y)).cogroup(spread(rc, every(n_x), own(n_y)))
    pairs = met.applyInArrow(meet, f"a array<{kind(lc)}>, b array<{kind(rc)}>, score double" + ", paths array<string>" * named)
    return pairs.withColumn("a", F.explode("a")).withColumn("b", F.explode("b"))


def linked(left: DataFrame, right: DataFrame, least: float = SUGGEST) -> DataFrame:
    """(a, b, score): pairs of bags (id, token, w) whose weighted Jaccard similarity is at least `least`; as linked_rows."""
    return linked_rows(bag_rows(left), bag_rows(right), least)


def recent_commits(commits: DataFrame, since: str | None = None, most: int | None = None) -> DataFrame:
    """commits on or after a day (as written, for ISO dates) and of these the newest `most`, ties by commit_no."""
    kept = commits if since is None else commits.where(F.col("commit_date") >= since)
    return kept if most is None else kept.orderBy(F.desc("commit_date"), "commit_no").limit(most)


def new_links(memories: DataFrame, commits: DataFrame, least: float = SUGGEST, auto: float = AUTO) -> DataFrame:
    """(mem_no, commit_no, score, band, paths): links that a record does not have yet.

    Commits whose full_sha a record's links name are left out. band is auto or suggest; paths
    are the commit's paths that share a word with the record, else its first five.
    """
    sha = F.explode("links.implementations.sha")
    known = memories.select(F.col("mem_no").alias("id"), sha.alias("sha")).where("sha is not null").groupBy("id").agg(F.collect_set("sha").alias("known"))
    told = commits.select(F.col("commit_no").alias("id"), F.col("full_sha").alias("sha"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))
    pairs = linked_rows(bag_rows(memory_bag(memories)).join(known, "id", "left"), bag_rows(commit_bag(commits)).join(told, "id"), least)
    band = F.when(F.col("score") >= auto, "auto").otherwise("suggest")
    return pairs.select(F.col("a").alias("mem_no"), F.col("b").alias("commit_no"), rounded(F.col("score")).alias("score"), band.alias("band"), "paths")


def rounded(score):
    """A score to three digits, half up."""
    return F.floor(score * 1000 + 0.5) / 1000
