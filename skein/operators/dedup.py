"""Removal of duplicate records, in the order in which they came or against those kept before."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import jstext
from skein.functions.jstext import TITLE_VERBS
from skein.operators import similarity
from skein.operators.similarity import CONTAINED, JACCARD
from skein.runtime import cut

#: Types that a todo may repeat.
ANCHORS = ("decision", "architecture", "convention")


def grams(text: str | None) -> frozenset:
    """The character trigrams of a squeezed text."""
    flat = re.sub(r"\s+", " ", (text or "").lower()).strip()
    return frozenset(flat[i : i + 3] for i in range(len(flat) - 2))


def keep_first(rows: list[dict]) -> list[dict]:
    """The rows of one extraction without duplicates, in order.

    A row whose normal title came before is dropped. A row that is similar to a kept row of its
    type takes that row's place if its content is longer, else it is dropped.
    """
    titles, kept = set(), []
    for row in rows:
        title = re.sub(r"[^\w一-鿿]", "", re.sub(rf"^(?:{TITLE_VERBS})\s+", "", (row["title"] or "").lower()), flags=re.ASCII)
        if title in titles:
            continue
        own = grams(row["content"])
        for i, (other, theirs) in enumerate(kept):
            if other["mem_type"] != row["mem_type"]:
                continue
            shared = len(own & theirs)
            union = len(own | theirs)
            alike = shared / union if union else 1.0
            small = min(len(own), len(theirs))
            if alike > JACCARD or (shared / small if small else 1.0) > CONTAINED:
                if len(row["content"] or "") > len(other["content"] or ""):
                    kept[i] = (row, own)
                break
        else:
            titles.add(title)
            kept.append((row, own))
    return [row for row, _ in kept]


def within(df: DataFrame, group: str, order: str) -> DataFrame:
    """df without the duplicates inside each group, read in `order`.

    Which row stays depends on the rows before it, so a group is one task's work; a group is one
    extraction, whose size the extractor bounds.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable").astype(object).where(part.notna(), None)
        kept = keep_first(part.to_dict("records"))
        return pd.DataFrame(kept, columns=part.columns)

    columns = [group, order, "mem_type", "title", "content"]
    kept = df.select(*dict.fromkeys(columns)).groupBy(group).applyInPandas(run, df.select(*dict.fromkeys(columns)).schema)
    return kept


def against(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """new without rows that are similar to an old row of their type, or contained in one."""
    n, o = similarity.shingle_sets(new, key, "mem_type", "content"), similarity.shingle_sets(old, key, "mem_type", "content")
    cn, co = similarity.classes(n), similarity.classes(o)
    digest = lambda df: df.withColumn("d", F.md5(F.array_join(F.transform("grams", lambda g: g.cast("string")), ",")))
    # more than JACCARD of both sets together is more than JACCARD of the new one
    found = similarity.met_in(cn, co, JACCARD).where((F.col("jaccard") > JACCARD) | (F.col("contained") > CONTAINED))
    reps = found.select(F.col("a").cast("string").alias("a")).distinct()
    bad = digest(cn).join(reps, F.col("rep").cast("string") == F.col("a"), "left_semi").select("grp", "d")
    gone = digest(n).join(bad.select(F.col("grp").alias("bg"), F.col("d").alias("bd")), F.col("grp").eqNullSafe(F.col("bg")) & (F.col("d") == F.col("bd")), "left_semi").select(F.col("id").alias("__gone"))
    return new.join(gone, F.col(key) == F.col("__gone"), "left_anti")


def without_repeated_todos(df: DataFrame, key: str, group: str) -> DataFrame:
    """df without todos whose title and content are contained in an anchor record of the same group."""
    todo = df.where("mem_type = 'todo'").withColumn("__t", F.concat_ws(" ", "title", "content"))
    anchor = df.where(F.col("mem_type").isin(*ANCHORS)).withColumn("__t", F.concat_ws(" ", "title", "content", "reasoning"))
    sets = similarity.shingle_sets(todo, key, group, "__t").select("grp", F.col("id").alias("rep"), F.lit(1).alias("copies"), "text", "grams").where(F.size("grams") > 0)
    others = similarity.shingle_sets(anchor, key, group, "__t").select("grp", F.col("id").alias("rep"), F.lit(1).alias("copies"), "text", "grams").where(F.size("grams") > 0)
    gone = similarity.contained_in(sets, others, CONTAINED).select(F.col("a").alias("__gone")).distinct()
    return df.join(gone, F.col(key) == F.col("__gone"), "left_anti")


def quality(df: DataFrame) -> DataFrame:
    """df with reason: why the record fails the quality filter, null where it passes."""
    return df.withColumn("reason", jstext.quality_reason(F.col("title"), F.col("content"), F.col("impact")))


def reindex(df: DataFrame, key: str = "mem_no") -> DataFrame:
    """(key, reason) of the records that a pass over the store removes: vague, duplicate or subsumed.

    Records of a type are read in the order of their keys. A record that is still there is
    compared with every later one that is: of two similar ones the one with fewer shingles goes
    if its content is shorter, else the other. What an earlier record removes is never compared
    again, so a record's fate depends only on earlier ones that would remove it: records are
    settled in rounds, each settling all whose earlier opponents are settled. Equal texts are one
    node, whose first record speaks for the others.
    """
    vague = jstext.is_vague(F.col("content"), F.col("impact"))
    rows = cut(df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), "mem_type", "content", vague.alias("vague"), F.length("content").alias("len")))
    sets = similarity.shingle_sets(rows.where("not vague"), "id", "mem_type", "content").where(F.size("grams") > 0)
    # digests instead of the sets, which take several times the room of their texts
    digests = sets.select("grp", "id", F.size("grams").alias("n_grams"), similarity.digest().alias("d"))
    keyed = cut(digests.join(rows.select("id", "len"), "id"))
    classes = similarity.classes(sets)
    nodes = cut(keyed.groupBy("grp", "d", "len").agg(F.min("id").alias("node"), F.first("n_grams").alias("size")).join(keyed.groupBy(F.col("grp").alias("g"), F.col("d").alias("h")).agg(F.min("id").alias("rep")), F.col("grp").eqNullSafe(F.col("g")) & (F.col("d") == F.col("h"))).select("node", "len", "size", "rep", "grp", "d"))
    pairs = similarity.similar_pairs(classes).select("a", "b", F.when(F.col("jaccard") > JACCARD, "duplicate").otherwise("subsumed").alias("why"))
    side = lambda x: nodes.select(F.col("rep").alias(x), F.col("node").alias(f"n{x}"), F.col("len").alias(f"l{x}"), F.col("size").alias(f"s{x}"))
    across = pairs.join(side("a"), "a").join(side("b"), "b")
    same = side("a").join(side("b").withColumnRenamed("b", "a2"), F.col("a") == F.col("a2")).where("na < nb").withColumn("why", F.lit("duplicate"))
    cols = ["na", "la", "sa", "nb", "lb", "sb", "why"]
    both = across.select(*cols).unionByName(same.select(*cols))
    first = F.col("na") < F.col("nb")
    early, late = F.struct(F.col("na").alias("n"), F.col("la").alias("l"), F.col("sa").alias("s")), F.struct(F.col("nb").alias("n"), F.col("lb").alias("l"), F.col("sb").alias("s"))
    edges = both.select(F.when(first, early).otherwise(late).alias("i"), F.when(first, late).otherwise(early).alias("j"), "why")
    small_first = F.col("i.s") <= F.col("j.s")
    gone_first = F.when(small_first, F.col("i.l") < F.col("j.l")).otherwise(F.col("j.l") >= F.col("i.l"))
    edges = cut(edges.select(F.col("i.n").alias("i"), F.col("j.n").alias("j"), gone_first.alias("first_goes"), "why"))
    against = cut(edges.where("not first_goes").select("i", "j"))
    settled = cut(nodes.select("node").join(against.select(F.col("j").alias("node")), "node", "left_anti").withColumn("kept", F.lit(True)))
    while True:
        left = against.join(settled.select(F.col("node").alias("j")), "j", "left_anti")
        known = left.join(settled.select(F.col("node").alias("i"), "kept"), "i", "left").groupBy("j").agg(F.max(F.coalesce("kept", F.lit(False))).alias("hit"), F.count_if(F.col("kept").isNull()).alias("open"))
        fresh = cut(known.where("hit or open = 0").select(F.col("j").alias("node"), (~F.col("hit")).alias("kept")))
        if fresh.isEmpty():
            break
        settled = settled.unionByName(fresh)
    alive = settled.where("kept").select(F.col("node").alias("i"))
    marks = against.join(alive, "i").select("i", "j")
    whys = edges.select("i", "j", "why")
    late_gone = marks.join(whys, ["i", "j"]).groupBy("j").agg(F.min(F.struct("i", "why")).alias("w")).select(F.col("j").alias("node"), F.col("w.i").alias("at"), F.col("w.why").alias("why"))
    first_mark = marks.groupBy(F.col("j").alias("jj")).agg(F.min("i").alias("by"))
    own = edges.where("first_goes").join(alive, "i").join(first_mark, F.col("j") == F.col("jj"), "left").where(F.col("by").isNull() | (F.col("by") > F.col("i")))
    early_gone = own.groupBy("i").agg(F.min(F.struct("j", "why")).alias("w")).select(F.col("i").alias("node"), F.col("i").alias("at"), F.col("w.why").alias("why"))
    heads = nodes.select("grp", "d", "len", "node")
    members = keyed.select("id", F.col("grp").alias("g"), F.col("d").alias("h"), F.col("len").alias("n")).join(heads, F.col("g").eqNullSafe(F.col("grp")) & (F.col("h") == F.col("d")) & (F.col("n") == F.col("len"))).select("id", "node")
    # the later copies of a node that an earlier record does not remove are removed by the node itself
    fate = members.join(late_gone.select("node", "why"), "node", "left").join(early_gone.select("node", F.col("why").alias("own")), "node", "left")
    reason = F.coalesce("why", F.when(F.col("id") == F.col("node"), F.col("own")).otherwise(F.lit("duplicate")))
    similar = fate.select("id", reason.alias("reason")).where("reason is not null")
    return rows.where("vague").select("id", F.lit("vague").alias("reason")).unionByName(similar).withColumnRenamed("id", key)
