"""Exact similarity joins of short texts by character shingles.

Texts with equal shingles form a class that is joined once, through its lowest id. Character
shingles of a language are few and most texts share many of them, so lists of who has a shingle are
nearly as long as all pairs. Texts are therefore compared block by block, first as matrices of bits:
a shingle whose bit the other text lacks is missing there for certain, which bounds what two sets
share from above. Pairs whose bound qualifies are counted on the whole sets in the same task. No
qualifying pair is lost, and only texts are moved, once for every block they meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import jstext
from skein.runtime import cut

#: Jaccard above the first, or containment of the smaller text above the second, is a duplicate.
JACCARD, CONTAINED = 0.55, 0.75
#: Bits of a text, of which the last SHARED stand for several shingles, and rows that are compared at once.
BITS, SHARED, STEP = 1024, 256, 1_000
#: The fewest and the most rows of a block, and the blocks that a group has while they are not too large.
LEAST_ROWS, MOST_ROWS, BLOCKS = 4_000, 16_000, 12
#: What rounding may take from a bound.
SLACK = 1 - 1e-5


def gram_hashes(text) -> F.Column:
    """The shingles of a text as sorted hashes."""
    return F.array_sort(F.transform(jstext.shingles(text), lambda g: F.xxhash64(g)))


def digest() -> F.Column:
    """One text for a set of shingles."""
    return F.md5(F.array_join(F.transform("grams", lambda g: g.cast("string")), ","))


def shingle_sets(df: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """(grp, id, text, grams) of every row, text squeezed and grams as sorted hashes; rows without id are left out, a null group is one group."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(group).alias("grp"), F.col(key).alias("id"), jstext.squeezed(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    return rows.withColumn("grams", gram_hashes(F.col("text")))


def classes(sets: DataFrame) -> DataFrame:
    """(grp, rep, copies, text, grams): one row per group and set of shingles, rep the lowest id. Empty sets are left out.

    text is that of one member; texts are moved, not the larger sets.
    """
    rows = sets.where(F.size("grams") > 0).select("grp", digest().alias("digest"), "id", "text")
    one = rows.groupBy("grp", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("text").alias("text"))
    return one.select("grp", "rep", "copies", "text").withColumn("grams", gram_hashes(F.col("text")))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of squeezed texts, each shingle of a row once, in order; a shingle is its three characters as one number."""
    rows = np.repeat(np.arange(len(texts)), [max(0, len(t) - 2) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if not len(rows):
        return rows, np.zeros(0, dtype=np.int64)
    starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
    within = np.arange(len(rows)) - np.searchsorted(rows, rows)
    at = starts[rows] + within
    keys = (codes[at] << 42) | (codes[at + 1] << 21) | codes[at + 2]
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[new], keys[new]


def shared_counts(xs: list[str], ys: list[str], qualifies: Callable) -> tuple[np.ndarray, ...]:
    """(r, c, n, m, s) of rows r of xs and c of ys, with n and m shingles and s of them shared, that qualify."""
    (rx, kx), (ry, ky) = trigrams(xs), trigrams(ys)
    words, ids, seen = np.unique(np.concatenate([kx, ky]), return_inverse=True, return_counts=True)
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.argsort(-seen, kind="stable")] = np.arange(len(words))
    ix, iy = rank[ids[: len(kx)]], rank[ids[len(kx) :]]
    own = BITS - SHARED
    bit = lambda i: np.where(i < own, i, own + i % SHARED)
    nx, ny = np.bincount(rx, minlength=len(xs)), np.bincount(ry, minlength=len(ys))
    at_x, at_y = np.cumsum(nx) - nx, np.cumsum(ny) - ny
    b = np.zeros((len(ys), BITS), dtype=np.float32)
    b[ry, bit(iy)] = 1
    spare_y = (ny - b.sum(axis=1)).astype(np.float32)
    mark, out = np.zeros(len(words), dtype=bool), []
    for lo in range(0, len(xs), STEP):
        hi = min(lo + STEP, len(xs))
        part = slice(at_x[lo], at_x[hi - 1] + nx[hi - 1])
        a = np.zeros((hi - lo, BITS), dtype=np.float32)
        a[rx[part] - lo, bit(ix[part])] = 1
        # sets share at most the common bits, and what else fell on bits that are taken
        most = a @ b.T + np.minimum((nx[lo:hi] - a.sum(axis=1)).astype(np.float32)[:, None], spare_y[None, :])
        near = qualifies(most, nx[lo:hi, None].astype(np.float32), ny[None, :].astype(np.float32), SLACK)
        for r in np.flatnonzero(near.any(axis=1)):
            c = np.flatnonzero(near[r])
            c = c[ny[c] > 0]
            mine = ix[at_x[lo + r] : at_x[lo + r] + nx[lo + r]]
            if not len(c) or not len(mine):
                continue
            mark[mine] = True
            ends = np.cumsum(ny[c])
            theirs = iy[np.arange(ends[-1]) + np.repeat(at_y[c] - (ends - ny[c]), ny[c])]
            s = np.add.reduceat(mark[theirs].astype(np.int64), ends - ny[c])
            mark[mine] = False
            yes = qualifies(s, nx[lo + r], ny[c], 1)
            out.append((np.full(yes.sum(), lo + r), c[yes], np.full(yes.sum(), nx[lo + r]), ny[c][yes], s[yes]))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else tuple(np.zeros(0, dtype=np.int64) for _ in range(5))


def blocks_met(left: DataFrame, right: DataFrame | None, qualifies: Callable) -> DataFrame:
    """(grp, a, b, na, nb, shared): rows of left and right (grp, rep, text) of one group that qualify; without right each pair within left once.

    qualifies(shared, n_a, n_b, slack) says of arrays whether so many shared shingles do. A large
    group is cut to blocks, each pair of which is a task; small groups share tasks. The time grows
    with the square of a group, by about a thousand multiplications a pair.
    """
    alone = right is None
    left = cut(left.select("grp", "rep", "text"))
    right = left if alone else cut(right.select("grp", "rep", "text"))
    sizes = (left if alone else left.select("grp").unionByName(right.select("grp"))).groupBy("grp").agg(F.count("*").alias("m"))
    rows = min(MOST_ROWS, max(LEAST_ROWS, -(-(sizes.agg(F.max("m")).first()[0] or 0) // BLOCKS)))
    sizes = cut(sizes.select(F.col("grp").alias("sg"), "m", F.ceil(F.col("m") / rows).cast("int").alias("blocks")))
    few = F.col("blocks") == 1
    totals = sizes.agg(F.sum(F.when(few, F.col("m"))).alias("small"), F.sum(F.when(~few, F.col("blocks") * F.col("blocks"))).alias("pairs")).first()
    small = max(12, -(-(totals.small or 0) // rows))
    # as many partitions as keep tasks apart; by their bytes they would be too few for what a task computes
    parts = min(400, 2 * (small + (totals.pairs or 0)))
    gh = F.xxhash64("grp")

    def spread(df: DataFrame, first: bool):
        low, high = (F.lit(0), F.col("blocks") - 1) if not alone else (F.col("own"), F.col("blocks") - 1) if first else (F.lit(0), F.col("own"))
        placed = df.join(sizes.drop("m").hint("merge"), F.col("grp").eqNullSafe(F.col("sg"))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("met", F.explode(F.sequence(low, high)))
        lane = F.when(few, F.pmod(gh, F.lit(small))).otherwise(gh).alias("lane")
        placed = placed.select(lane, F.col("own" if first else "met").alias("i"), F.col("met" if first else "own").alias("j"), *(F.col(c).alias(c) for c in ("grp", "rep", "text")))
        return placed.repartition(parts, "lane", "i", "j").groupBy("lane", "i", "j")

    texts = {c for c, df in (("a", left), ("b", right)) if df.schema["rep"].dataType.simpleString() == "string"}

    def meet(xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: pd.Series([], dtype=object if c == "grp" or c in texts else "int64") for c in ("grp", "a", "b", "na", "nb", "shared")})]
        if not len(xs) or not len(ys):
            return out[0]
        named = lambda df: df.groupby(np.array(["null" if pd.isna(g) else f"group {g}" for g in df["grp"]], dtype=object))
        theirs = dict(iter(named(ys)))
        for name, x in named(xs):
            y = theirs.get(name)
            if y is None:
                continue
            r, c, n, m, s = shared_counts(x["text"].tolist(), y["text"].tolist(), qualifies)
            a, b = x["rep"].to_numpy()[r], y["rep"].to_numpy()[c]
            found = pd.DataFrame({"grp": x["grp"].iloc[0], "a": a, "b": b, "na": n, "nb": m, "shared": s})
            out.append(found[a < b] if alone and x["i"].iloc[0] == x["j"].iloc[0] else found)
        found = pd.concat(out[1:] or out)
        # texts in several chunks are not taken by Arrow as one column
        plain = {c: pd.Series([None if pd.isna(v) else v for v in found[c]], index=found.index, dtype=object) for c in ("grp", "a", "b") if not pd.api.types.is_integer_dtype(found[c])}
        return found.assign(**plain)

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return spread(left, True).cogroup(spread(right, False)).applyInPandas(meet, f"grp {kind(left, 'grp')}, a {kind(left, 'rep')}, b {kind(right, 'rep')}, na bigint, nb bigint, shared bigint")


def similar_pairs(sets: DataFrame) -> DataFrame:
    """(grp, a, b, jaccard, contained) of all class representatives a, b of a group that are duplicates; a has the smaller set.

    Of sets of one size a is the lower id. Members of a class follow from classes().
    """
    alike = lambda s, n, m, slack: (s / (n + m - s) > JACCARD * slack) | (s / np.minimum(n, m) > CONTAINED * slack)
    pairs = blocks_met(sets, None, alike)
    swap = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    return pairs.select("grp", pick("a", "b").alias("a"), pick("b", "a").alias("b"), (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.least("na", "nb")).alias("contained"))


def met_in(new: DataFrame, old: DataFrame, share: float) -> DataFrame:
    """(a, b, jaccard, contained) of classes a of new and b of old, of one group, that share `share` or more of a's grams. Exact."""
    pairs = blocks_met(new, old, lambda s, n, m, slack: s / np.maximum(n, 1) >= share * slack)
    return pairs.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.col("na")).alias("contained"))


def contained_in(new: DataFrame, old: DataFrame, bound: float) -> DataFrame:
    """(a, b, contained): classes a of new whose grams are contained by more than `bound` in a class b of old of the same group.

    Directed and exact; the sizes of the two sets do not matter.
    """
    return met_in(new, old, bound).where(F.col("contained") > bound).select("a", "b", "contained")
