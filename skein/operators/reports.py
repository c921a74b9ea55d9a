"""Reports over the record store: dashboards, conversations, quality, history and benchmark scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import jstext
from skein.functions.jstext import WS
from skein.operators import similarity
from skein.operators.extraction import TYPES
from skein.runtime import cut


def contains_any(columns: tuple[str, ...], words: str) -> Column:
    """Whether one of the columns contains the words, in any case; false where all are null."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c)), F.lit(words.lower())), F.lit(False)) for c in columns))


def filtered(memories: DataFrame, types: tuple[str, ...] = (), author: str | None = None, status: str | None = None, words: str | None = None) -> DataFrame:
    """Records of the given types, author and status (active where none is written) whose title, content or context contains the words."""
    kept = memories.where(F.col("mem_type").isin(*types)) if types else memories
    kept = kept if author is None else kept.where(F.col("author") == author)
    kept = kept if status is None else kept.where(F.coalesce("status", F.lit("active")) == status)
    return kept if not words else kept.where(contains_any(("title", "content", "context"), words))


def focused(memories: DataFrame, words: str) -> DataFrame:
    """Records whose title, content or impact contains the words; none where nothing does."""
    return memories.where(contains_any(("title", "content", "impact"), words))


def page(memories: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of the records by newest date, then mem_no; only the pages up to it are ranked."""
    return memories.orderBy(F.desc(F.coalesce("mem_date", F.lit(""))), "mem_no").offset((number - 1) * size).limit(size)


def visible_edges(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """The edges (a, b) whose both ends are among visible (mem_no)."""
    ends = visible.select("mem_no").distinct()
    return edges.join(ends.withColumnRenamed("mem_no", "a"), "a", "left_semi").join(ends.withColumnRenamed("mem_no", "b"), "b", "left_semi").select("a", "b")


def newest(memories: DataFrame, n: int = 10) -> DataFrame:
    """The n newest records by date as written, then mem_no."""
    return memories.orderBy(F.desc(F.coalesce("mem_date", F.lit(""))), "mem_no").limit(n)


def conversation_types(memories: DataFrame) -> DataFrame:
    """(source_id, mem_type, n): records of every conversation by type."""
    return memories.where(F.coalesce("source_id", F.lit("")) != "").groupBy("source_id", "mem_type").agg(F.count("*").alias("n"))


def conversation_records(memories: DataFrame) -> DataFrame:
    """(source_id, mem_no, id, title, mem_date, status, author): the records that a conversation's card lists; they are read by newest date, then mem_no.

    author is that of the conversation's record with the lowest mem_no.
    """
    rows = memories.where(F.coalesce("source_id", F.lit("")) != "")
    first = rows.groupBy(F.col("source_id").alias("__s")).agg(F.min_by("author", "mem_no").alias("first_author"))
    joined = rows.join(first, F.col("source_id") == F.col("__s"))
    key = jstext.memory_id(F.col("mem_type"), F.col("title"), F.col("mem_date"))
    return joined.select("source_id", "mem_no", key.alias("id"), "title", F.coalesce("mem_date", F.lit("")).alias("mem_date"), F.coalesce("status", F.lit("active")).alias("status"), F.col("first_author").alias("author"))


def near_pairs(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes (grp, rep, copies) of records with equal shingles, and the similar pairs of them."""
    classes = similarity.classes(similarity.shingle_sets(memories, "mem_no", "mem_type", "content"))
    return cut(classes.select("grp", "rep", "copies")), cut(similarity.similar_pairs(classes).select("a", "b", "jaccard"))


def pair_counts(memories: DataFrame, near: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(reason, n): pairs of records of one type that are duplicates or subsumed.

    Records with equal shingles are one class, whose pairs are counted from its size; pairs
    between classes count as often as their members can be paired. Contents below three
    characters have no shingles and are duplicates of each other.
    """
    sets = similarity.shingle_sets(memories, "mem_no", "mem_type", "content")
    digest = F.md5(F.array_join(F.transform("grams", lambda g: g.cast("string")), ","))
    sizes = sets.groupBy("grp", digest.alias("d")).agg(F.count("*").alias("k"))
    within = sizes.select(F.lit("duplicate").alias("reason"), (F.col("k") * (F.col("k") - 1) / 2).cast("bigint").alias("n"))
    classes, pairs = near or near_pairs(memories)
    copies = lambda k, n: classes.select(F.col("rep").alias(k), F.col("copies").alias(n)).hint("merge")
    joined = pairs.join(copies("a", "x"), "a").join(copies("b", "y"), "b")
    across = joined.select(F.when(F.col("jaccard") > similarity.JACCARD, "duplicate").otherwise("subsumed").alias("reason"), (F.col("x") * F.col("y")).alias("n"))
    # an empty set is contained in every other one of its type
    empty = sets.groupBy("grp").agg(F.count_if(F.size("grams") == 0).alias("e"), F.count_if(F.size("grams") > 0).alias("f"))
    inside = empty.select(F.lit("subsumed").alias("reason"), (F.col("e") * F.col("f")).alias("n"))
    names = memories.sparkSession.createDataFrame([("duplicate",), ("subsumed",)], "reason string")
    sums = within.unionByName(across).unionByName(inside).groupBy("reason").agg(F.sum("n").alias("n"))
    return names.join(sums, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def flagged_paths(memories: DataFrame, near: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(file_path): files of records that are vague, or similar to another record of their type."""
    vague = memories.where(jstext.is_vague(F.col("content"), F.col("impact"))).select("file_path")
    sets = similarity.shingle_sets(memories, "mem_no", "mem_type", "content").withColumn("d", F.md5(F.array_join(F.transform("grams", lambda g: g.cast("string")), ",")))
    sizes = sets.groupBy(F.col("grp").alias("sg"), F.col("d").alias("sd")).agg(F.count("*").alias("k"), F.min("id").alias("rep"), F.first(F.size("grams") == 0).alias("empty"))
    _, pairs = near or near_pairs(memories)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().withColumn("near", F.lit(True))
    per_type = sizes.groupBy(F.col("sg").alias("tg")).agg(F.max("empty").alias("has_empty"), F.sum("k").alias("every"))
    state = sizes.join(ends, "rep", "left").join(per_type, F.col("sg").eqNullSafe(F.col("tg")))
    bad = state.where((F.col("k") > 1) | F.col("near") | (F.col("has_empty") & (F.col("every") > 1))).select("sg", "sd")
    alike = sets.join(bad, F.col("grp").eqNullSafe(F.col("sg")) & (F.col("d") == F.col("sd")), "left_semi").select(F.col("id").alias("__m"))
    return vague.unionByName(memories.join(alike, F.col("mem_no") == F.col("__m"), "left_semi").select("file_path")).distinct()


def quality_summary(memories: DataFrame) -> DataFrame:
    """(metric, n): total, vague, duplicates, subsumed, flagged, healthy and flagged_pct of the store."""
    counts = memories.agg(F.count("*").alias("total"), F.count_if(jstext.is_vague(F.col("content"), F.col("impact"))).alias("vague"))
    near = near_pairs(memories)
    pairs = pair_counts(memories, near).agg(F.max(F.when(F.col("reason") == "duplicate", F.col("n"))).alias("duplicates"), F.max(F.when(F.col("reason") == "subsumed", F.col("n"))).alias("subsumed"))
    flagged = flagged_paths(memories, near).agg(F.count("*").alias("flagged"))
    # one row each
    one = counts.join(pairs, F.lit(True)).join(flagged, F.lit(True))
    one = one.withColumn("healthy", F.col("total") - F.col("flagged")).withColumn("flagged_pct", F.when(F.col("total") > 0, F.floor(100 * F.col("flagged") / F.col("total") + 0.5)).otherwise(0))
    names = ("total", "vague", "duplicates", "subsumed", "flagged", "healthy", "flagged_pct")
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("bigint").alias("n")) for n in names))).alias("r")).select("r.metric", "r.n")


def vague_samples(memories: DataFrame, n: int = 20) -> DataFrame:
    """The first n vague records by mem_no, their contents cut to 180 characters."""
    rows = memories.where(jstext.is_vague(F.col("content"), F.col("impact")))
    return rows.orderBy("mem_no").limit(n).select("mem_no", "mem_type", "title", F.substring("content", 1, 180).alias("content"), "file_path")


def file_history(memories: DataFrame, commits: DataFrame) -> DataFrame:
    """(mem_no, mem_date, commits, last_commit): the history of the files that a record's links name.

    A record is placed by its newest commit, else by its own date (`place`). Dates are compared
    as written. A commit listed twice counts once.
    """
    named = F.filter(F.flatten(F.transform("links.implementations", lambda x: F.coalesce(x["paths"], F.array().cast("array<string>")))), lambda p: p.isNotNull())
    linked = memories.select("mem_no", F.array_sort(F.array_distinct(named)).alias("files")).where("size(files) > 0")
    changes = commits.where("full_sha is not null").select("full_sha", "commit_date", F.explode("paths").alias("path")).where("path is not null")
    # records of the same files, and commits of the same files, meet once
    asked = linked.select("files").distinct().select("files", F.explode("files").alias("path"))
    made = changes.groupBy("full_sha").agg(F.array_sort(F.collect_set("path")).alias("changed")).groupBy("changed").agg(F.count("*").alias("n")).select("changed", "n", F.explode("changed").alias("path"))
    once = F.array_min(F.array_intersect("files", "changed")) == F.col("path")
    both = asked.join(made.hint("merge"), "path").where(once).groupBy("files").agg(F.sum("n").alias("commits"))
    last = asked.join(changes.groupBy("path").agg(F.max("commit_date").alias("date")), "path").groupBy("files").agg(F.max("date").alias("last_commit"))
    met = linked.join(both, "files").join(last, "files").select("mem_no", "commits", "last_commit")
    joined = memories.select("mem_no", "mem_date").join(met, "mem_no", "left")
    return joined.select("mem_no", F.coalesce("commits", F.lit(0)).alias("commits"), "last_commit", F.coalesce("last_commit", "mem_date").alias("place"))


def by_node(memories: DataFrame, node: str) -> DataFrame:
    """The records with a node id of the graph."""
    return memories.where(jstext.node_id(F.col("mem_type"), F.col("mem_date"), F.col("title")) == node)


def listing(metas: DataFrame, done: DataFrame) -> DataFrame:
    """(conv_id, title, turns, mark) of every conversation: [+] extracted, [~] open, [ ] without turns; read by newest modified_at.

    The meta row with the highest turn count, then the lowest meta_no, speaks for a conversation.
    """
    best = metas.where("conv_id is not null").groupBy("conv_id").agg(F.max_by(F.struct("title", "turn_count"), F.struct(F.coalesce("turn_count", F.lit(-1)), -F.col("meta_no"))).alias("m"))
    have = done.where("source_id is not null").select(F.col("source_id").alias("__s")).distinct()
    mark = F.when(F.col("__s").isNotNull(), "[+]").when(F.coalesce("m.turn_count", F.lit(0)) > 0, "[~]").otherwise("[ ]")
    return best.join(have, F.col("conv_id") == F.col("__s"), "left").select("conv_id", "m.title", F.col("m.turn_count").alias("turns"), mark.alias("mark"))


def display_width(text: Column) -> Column:
    """The columns a text takes: two for a character above U+2E7F."""
    return F.length(text) + F.coalesce(F.regexp_count(text, F.lit(r"[^\x{0000}-\x{2E7F}]")), F.lit(0))


# --- benchmark scores ---------------------------------------------------------------------------

#: Words of an answer that prove nothing, and the shortest word that may.
ANSWER_STOPWORDS = [
    "the", "a", "an", "is", "was", "are", "were", "be", "been", "being", "it", "its", "that", "this", "these", "those", "to", "of", "in", "on", "at", "for", "with", "and", "or", "but", "as", "by", "from", "into",
    "i", "you", "he", "she", "we", "they", "my", "your", "our", "their", "do", "did", "does", "have", "has", "had", "will", "would", "could", "should", "can",
]
LEAST_TOKEN = 3


def key_tokens(answer: Column) -> Column:
    """The distinct words of an answer that must be found again: three characters or more, no stop words, hyphens kept."""
    flat = F.regexp_replace(F.lower(F.coalesce(answer, F.lit(""))), rf"[^\p{{L}}\p{{N}}\-{WS[1:-1]}]+", " ")
    return F.array_distinct(F.filter(F.split(flat, f"{WS}+"), lambda w: (F.length(w) >= LEAST_TOKEN) & ~w.isin(*ANSWER_STOPWORDS)))


def searchable(*columns: str) -> Column:
    """What a benchmark looks for words in: the fields joined, lower case."""
    return F.lower(F.concat_ws(" \n ", *(F.coalesce(F.col(c), F.lit("")) for c in columns)))


def evidence(rows: DataFrame, tokens: Column, text: Column) -> DataFrame:
    """rows with matched, missed, full and partial: which tokens the text contains; half or more is partial, no tokens are full."""
    bound = rows.withColumn("__t", tokens).withColumn("__x", text)
    hit = F.filter("__t", lambda w: F.contains(F.col("__x"), w))
    scored = bound.withColumn("matched", hit).withColumn("missed", F.array_except("__t", "matched")).withColumn("full", F.size("missed") == 0)
    return scored.withColumn("partial", ~F.col("full") & (2 * F.size("matched") >= F.size("__t"))).drop("__t", "__x")


def evidence_by_type(scored: DataFrame, kind: str) -> DataFrame:
    """(kind, n, full, partial, rate) of evidence rows without an error; rate is full over n."""
    rows = scored.where("error is null") if "error" in scored.columns else scored
    sums = rows.groupBy(kind).agg(F.count("*").alias("n"), F.count_if("full").alias("full"), F.count_if("partial").alias("partial"))
    return sums.withColumn("rate", F.col("full") / F.col("n"))


def eligible(samples: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Samples (id, kind, answer, answer_is_text) that can be scored: no abstention, an answer in words, a known kind."""
    return samples.where(~F.endswith("id", F.lit("_abs")) & F.col("answer_is_text") & F.col("kind").isin(*types) & (F.size(key_tokens(F.col("answer"))) > 0))


def by_fixture(outcomes: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(fixture_id, tp, fp, fn, f1, perfect) of every fixture (fixture_id, error); outcomes has (fixture_id, outcome).

    A fixture that expects nothing and gets nothing scores 1; one with an error scores 0.
    """
    sums = outcomes.groupBy("fixture_id").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")))
    rows = fixtures.join(sums, "fixture_id", "left").na.fill(0, ["tp", "fp", "fn"])
    rows = rows.select("fixture_id", "error", *(F.when(F.col("error").isNull(), F.col(c)).otherwise(0).alias(c) for c in ("tp", "fp", "fn")))
    all_ = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(F.col("error").isNotNull(), 0.0).when(all_ == 0, 1.0).otherwise(2 * F.col("tp") / F.when(all_ == 0, 1).otherwise(all_))
    return rows.select("fixture_id", "tp", "fp", "fn", f1.alias("f1"), (F.col("error").isNull() & (F.col("fp") + F.col("fn") == 0)).alias("perfect"))


def misses(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """(fixture_id, pos, hits, needed, closest, same_type) of expected records: the extracted record of their type with most of their words.

    expected has fixture_id, pos, mem_type and must; extracted fixture_id, pos, mem_type, title
    and text. Ties go to the lower pos; closest is null where no word is found.
    """
    e = expected.select("fixture_id", F.col("pos").alias("e"), "mem_type", "must")
    x = extracted.select("fixture_id", F.col("pos").alias("x"), "mem_type", "title", F.lower("text").alias("text"))
    hits = F.size(F.filter("must", lambda w: F.contains(F.col("text"), F.lower(w))))
    met = e.join(x, ["fixture_id", "mem_type"], "left").withColumn("hits", F.when(F.col("x").isNotNull(), hits))
    best = met.groupBy("fixture_id", "e").agg(F.max(F.struct("hits", -F.col("x"), "title")).alias("b"), F.count("x").alias("same_type"), F.first(F.size("must")).alias("needed"))
    return best.select("fixture_id", F.col("e").alias("pos"), F.coalesce("b.hits", F.lit(0)).alias("hits"), "needed", F.when(F.col("b.hits") > 0, F.col("b.title")).alias("closest"), "same_type")


def scorecard(types: list, fixtures: list) -> str:
    """The score table of by_type and by_fixture rows as Markdown."""
    lines = ["| type | tp | fp | fn | precision | recall | f1 |", "|---|---|---|---|---|---|---|"]
    lines += [f"| {r.mem_type} | {r.tp} | {r.fp} | {r.fn} | {r.precision:.2f} | {r.recall:.2f} | {r.f1:.2f} |" for r in types]
    lines += ["", "| fixture | tp | fp | fn | f1 |", "|---|---|---|---|---|"]
    return "\n".join(lines + [f"| {r.fixture_id} | {r.tp} | {r.fp} | {r.fn} | {r.f1:.2f} |" for r in fixtures]) + "\n"


def checks(memories: DataFrame) -> DataFrame:
    """(status, n): a store's checks by result. A record without type, title or content fails, one without date or author is warned of, else it is ok."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    status = F.when(~F.coalesce(F.col("mem_type").isin(*TYPES), F.lit(False)) | blank("title") | blank("content"), "fail").when(blank("mem_date") | blank("author"), "warn").otherwise("ok")
    return memories.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
