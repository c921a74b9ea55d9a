"""Documents that hold template residue, filler, error pages or script notices instead of content.

A document is cut into fields: what a label or a speaker introduces, and the rest. Rules give
trusted labels to fields that are residue as a whole. Near copies of such fields, which the rules
do not know, are found by SimHash tables: a field's 64-bit SimHash is split into 8 bytes, adjacent
bytes around a ring key 8 tables, and the fields labelled last probe every table within one bit of
either byte. Pairs that meet are verified by Hamming distance and by the Jaccard similarity of
their five-word shingles. A SimHash of few words can lie far from that of a near copy, so a prefix
filter on the shingles brings what the tables miss: no link of that similarity is lost. The label
spreads along the links, round by round, until the components that hold a trusted label are
covered. Exact copies of a field are one node.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.residue_rules import CHROME, OTHER, RESIDUE, cleaned, fields_of, kind_of, units_of
from skein.runtime import cut

SHINGLE, SIMILAR, HAMMING = 5, 0.8, 12
WORD = re.compile(r"[⺀-鿿]|[^\W\d_]+|\d+")


def label_of(text: str) -> str:
    """The residue kind of a field that is residue as a whole, chrome if it has no content at all, else other.

    Heading lines are no content. Reading stops at the first unit that is content.
    """
    found = CHROME
    for unit in units_of(text):
        kind = kind_of(unit)
        if kind == OTHER and not re.match(r"\s*#{1,6}\s", unit):
            return OTHER
        if kind in RESIDUE and found == CHROME:
            found = kind
    return found


def words_of(text: str) -> list[str]:
    """The words of a text, lower case; each CJK character is one."""
    return WORD.findall(text.lower())


def jaccard(a: str, b: str) -> float:
    """Jaccard similarity of the five-word shingles of two texts; a shorter text is one shingle."""
    sets = []
    for text in (a, b):
        w = text.split(" ")
        sets.append({tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def simhashes(word_lists: list[list[str]]) -> list[int]:
    """A signed 64-bit SimHash of each list of words, every occurrence counted."""
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64) for words in word_lists]
    digests = np.array([xxhash.xxh64_intdigest(w) for w in index], dtype=np.uint64)
    signs = np.unpackbits(digests.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1 if len(index) else np.zeros((0, 64), np.int8)
    out = []
    for row in ids:
        total = signs[row].sum(axis=0, dtype=np.int32) if len(row) else np.zeros(64, np.int32)
        out.append(int(np.packbits(total > 0).view(np.int64)[0]))
    return out


FIELDS = "doc_id bigint, place string, label string, node bigint, simhash bigint, words string"


def labelled_fields(documents: DataFrame) -> DataFrame:
    """(doc_id, place, label, node, simhash, words) of every field of every document; node is the digest of its words.

    Null, empty and blank texts have no fields.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if text is None or not text.strip():
                    continue
                for place, field in fields_of(cleaned(text)):
                    rows.append((doc_id, place, label_of(field), words_of(field)))
            codes = simhashes([r[3] for r in rows])
            joined = [" ".join(r[3]) for r in rows]
            out = [(*r[:3], xxhash.xxh64_intdigest(w) - 2**63, c, w) for r, c, w in zip(rows, codes, joined)]
            yield pd.DataFrame(out, columns=["doc_id", "place", "label", "node", "simhash", "words"])

    return documents.select("doc_id", "text").mapInPandas(run, FIELDS)


def keys(nodes: DataFrame, probe: bool) -> DataFrame:
    """(slot, key, node, simhash): a node's keys in the 8 tables, for a probe all within one bit of either byte."""
    byte = lambda i: F.shiftrightunsigned("simhash", i * 8).bitwiseAND(F.lit(255))
    pair = F.array(*(F.struct(F.lit(i).alias("slot"), (byte(i) * 256 + byte((i + 1) % 8)).alias("key")) for i in range(8)))
    rows = nodes.select("node", "simhash", F.explode(pair).alias("p")).select("p.slot", "p.key", "node", "simhash")
    if not probe:
        return rows
    flips = sorted({a * 256 + b for a in [0, *(1 << i for i in range(8))] for b in [0, *(1 << i for i in range(8))]})
    rows = rows.withColumn("flip", F.explode(F.array(*(F.lit(x).cast("bigint") for x in flips))))
    return rows.withColumn("key", F.col("key").bitwiseXOR(F.col("flip"))).drop("flip")


def prefixes(nodes: DataFrame) -> DataFrame:
    """(gram, node, size): the lowest hashes of a node's shingles, so many that two nodes of SIMILAR or more share one of both.

    Sets of sizes m and n with a Jaccard similarity s share at least s * max(m, n) shingles, so
    the lowest that they share is among the lowest m - ceil(s * m) + 1 of either.
    """

    def hashed(w):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, SHINGLE), " ")))

    # The words are bound once; written into the inner lambda they would be split again for every shingle.
    every = F.flatten(F.transform(F.array(F.split("words", " ")), hashed))
    grams = nodes.select("node", F.array_sort(F.array_distinct(every)).alias("grams"))
    size = F.size("grams")
    first = size - F.ceil(size * SIMILAR - 1e-9).cast("int") + 1
    return grams.select("node", size.alias("size"), F.explode(F.slice("grams", F.lit(1), first)).alias("gram"))


def similarity(a: str, b: str):
    """jaccard of two columns of words joined by blanks."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaccard(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def spread_labels(fields: DataFrame) -> DataFrame:
    """(node, label) of the nodes that a trusted label reaches through near-duplicate links, trusted ones included."""
    nodes = fields.groupBy("node").agg(F.first("simhash").alias("simhash"), F.first("words").alias("words"), F.max(F.when(F.col("label").isin(*RESIDUE), F.col("label"))).alias("label"), F.max(F.col("label") == OTHER).alias("open"))
    nodes = cut(nodes.where("label is not null or open"))
    index = keys(nodes.where("label is null"), probe=False)
    grams = prefixes(nodes.where("label is null")).select("gram", F.col("node").alias("c"), F.col("size").alias("nc"))
    texts = nodes.select("node", "words", "simhash")
    reached = frontier = nodes.where("label is not null").select("node", "simhash", "label")
    while True:
        probes = keys(frontier.select("node", "simhash"), probe=True)
        q, c = probes.select("slot", "key", F.col("node").alias("q"), F.col("simhash").alias("hq")), index.select("slot", "key", F.col("node").alias("c"), F.col("simhash").alias("hc"))
        close = q.join(c, ["slot", "key"]).where(F.bit_count(F.col("hq").bitwiseXOR(F.col("hc"))) <= HAMMING).select("q", "c")
        ours = prefixes(frontier.select("node").join(texts, "node")).select("gram", F.col("node").alias("q"), F.col("size").alias("nq"))
        sized = (F.least("nq", "nc") + 1e-9) >= SIMILAR * F.greatest("nq", "nc")
        pairs = close.unionByName(ours.join(grams, "gram").where(sized).select("q", "c")).distinct()
        pairs = pairs.join(reached.select(F.col("node").alias("seen")), F.col("c") == F.col("seen"), "left_anti")
        pairs = pairs.join(texts.select(F.col("node").alias("q"), F.col("words").alias("wq")), "q").join(texts.select(F.col("node").alias("c"), F.col("words").alias("wc"), F.col("simhash").alias("hc")), "c")
        linked = pairs.where(similarity("wq", "wc") >= SIMILAR).select("q", F.col("c").alias("node"), F.col("hc").alias("simhash"))
        labels = frontier.select(F.col("node").alias("q"), "label")
        fresh = cut(linked.join(labels, "q").groupBy("node").agg(F.first("simhash").alias("simhash"), F.min("label").alias("label")))
        if fresh.isEmpty():
            return reached.select("node", "label")
        reached, frontier = reached.unionByName(fresh), fresh


def marked(documents: DataFrame) -> DataFrame:
    """(doc_id, residue, kind) of every document with text.

    residue is true where a labelled or spoken field is residue, or where nothing but residue
    and chrome stands in the document; kind is its first residue kind by name.
    """
    fields = cut(labelled_fields(documents))
    spread = spread_labels(fields).select(F.col("node").alias("__node"), F.col("label").alias("reached"))
    rows = fields.select("doc_id", "place", "label", "node").join(spread, F.col("node") == F.col("__node"), "left")
    label = F.when(F.col("label") == OTHER, F.coalesce("reached", F.lit(OTHER))).otherwise(F.col("label"))
    rows = rows.select("doc_id", "place", label.alias("label")).withColumn("bad", F.col("label").isin(*RESIDUE))
    found = rows.groupBy("doc_id").agg(
        F.max(F.col("bad") & (F.col("place") == "field")).alias("in_field"), F.max("bad").alias("any"), F.max(F.col("label") == OTHER).alias("content"), F.min(F.when(F.col("bad"), F.col("label"))).alias("kind")
    )
    residue = F.col("in_field") | (F.col("any") & ~F.col("content"))
    return found.select("doc_id", residue.alias("residue"), F.when(residue, F.col("kind")).alias("kind"))


def clean_corpus(documents: DataFrame) -> DataFrame:
    """The documents without those marked as residue; documents without text stay."""
    bad = marked(documents).where("residue").select(F.col("doc_id").alias("__doc"))
    return documents.join(bad, F.col("doc_id") == F.col("__doc"), "left_anti")
