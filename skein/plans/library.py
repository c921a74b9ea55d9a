"""Queries of the library's own operators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import jstext
from skein.operators import context, dedup, extraction, linking, search, similarity, stats, store
from skein.plans import oracle
from skein.runtime import table

AS_OF = "2026-07-01"
QUERY = "retry budget in the session cache"


def _memories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories")


def _backup(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records under backup/ as the incoming side, the others as the stored side."""
    incoming = F.coalesce(F.startswith("file_path", F.lit("backup/")), F.lit(False))
    return df.where(incoming), df.where(~incoming)


def _arrivals(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records dated 2025 or later, as written, and backup copies as the incoming side, the others as the stored side."""
    incoming = (F.coalesce("mem_date", F.lit("")) >= "2025") | F.coalesce(F.startswith("file_path", F.lit("backup/")), F.lit(False))
    return df.where(incoming), df.where(~incoming)


def conversation_text(spark: SparkSession, d: str) -> DataFrame:
    """Turns, characters and approximate tokens of every conversation's cleaned text.

    User and assistant turns as written; assistant turns below 30 characters are left out; every
    turn is cleaned and gets its speaker's name in front. Sums need no conversation to be gathered.
    """
    rows = table(spark, d, "chat_messages").where("role in ('user', 'assistant') and text is not null and conv_id is not null").select("conv_id", "role", jstext.trim(F.col("text")).alias("t"))
    rows = rows.where("t <> '' and not (role = 'assistant' and length(t) < 30)")
    size = F.length(jstext.denoised(F.col("t"))) + F.when(F.col("role") == "user", len("User: ")).otherwise(len("Assistant: "))
    sums = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), (F.sum(size) + 2 * (F.count("*") - 1)).alias("n_chars"))
    return sums.select("conv_id", "n_turns", "n_chars", F.ceil(F.col("n_chars") / 4).alias("approx_tokens"))


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text without conversation noise, as length and digest."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", jstext.denoised(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


#: The default redaction rules, in order. The last one replaces only its second group.
RULES = [
    ("anthropic-key", r"sk-ant-(?:api03-)?[A-Za-z0-9_-]{20,}"),
    ("openai-key", r"sk-(?:proj-)?[A-Za-z0-9_-]{20,}"),
    ("aws-access-key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github-pat", r"ghp_[A-Za-z0-9]{36,}"),
    ("github-app-token", r"(?:gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    ("slack-bot-token", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    ("gcp-api-key", r"\bAIza[0-9A-Za-z_-]{35,}\b"),
    ("stripe-key", r"(?:sk|pk|rk)_(?:test|live)_[A-Za-z0-9]{20,}"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("internal-hostname", r"(^|[^A-Za-z0-9])([A-Za-z0-9][A-Za-z0-9-]*\.(?:internal|corp|local|lan|intra)\b)"),
]


#: The default rules; the host rule redacts its host and keeps the mark before it.
DEFAULT_RULES = [extraction.Rule(n, js) for n, js in RULES[:-1]] + [extraction.Rule(RULES[-1][0], RULES[-1][1].replace("(^|[^A-Za-z0-9])", "(?:^|[^A-Za-z0-9])"), group=1)]


def redact(text):
    """(redacted text, {rule: hits}) as columns."""
    state = extraction.redaction(text, DEFAULT_RULES)
    hits = lambda name: F.coalesce(F.get(F.filter(state["hits"], lambda h: h["rule"] == name), F.lit(0))["hits"], F.lit(0))
    return state["t"], {r.name: hits(r.name) for r in DEFAULT_RULES}


def _redacted(spark: SparkSession, d: str) -> DataFrame:
    """(msg_id, text, hits) of every message with text."""
    return extraction.redacted(table(spark, d, "chat_messages").where("text is not null").select("msg_id", "text"), "text", DEFAULT_RULES)


def redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every message's redacted text as digest, with its number of hits."""
    total = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, h: a + h["hits"])
    return _redacted(spark, d).select("msg_id", total.alias("hits"), F.md5("text").alias("digest"))


def redaction_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of every redaction rule over all messages, 0 for rules that never matched."""
    found = _redacted(spark, d).select(F.explode("hits").alias("h")).groupBy("h.rule").agg(F.sum("h.hits").alias("n"))
    names = spark.createDataFrame([(r.name,) for r in DEFAULT_RULES], "rule string")
    return names.join(found, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("hits"))


def redacted_chars(spark: SparkSession, d: str) -> DataFrame:
    """Characters that every redaction rule replaced over all messages, for rules that matched."""
    return _redacted(spark, d).select(F.explode("hits").alias("h")).groupBy("h.rule").agg(F.sum("h.chars").alias("chars"))


def redaction_trails(spark: SparkSession, d: str) -> DataFrame:
    """The audit trail of every message in which something was redacted."""
    return _redacted(spark, d).where("size(hits) > 0").select("msg_id", extraction.audit_trail(F.col("hits")).alias("trail"))


def titles(spark: SparkSession, d: str) -> DataFrame:
    """Normal title, slug, memory id and node id of every record."""
    k, t, m = F.col("mem_type"), F.col("title"), F.col("mem_date")
    rows = _memories(spark, d).where("title is not null")
    return rows.select("mem_no", jstext.normal_title(t).alias("normal"), jstext.slug(t).alias("slug"), jstext.memory_id(k, t, m).alias("id"), jstext.node_id(k, m, t).alias("node"))


def embed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Digest of what is embedded of every record."""
    text = jstext.embed_text(*(F.col(c) for c in ("mem_type", "title", "content", "context", "reasoning", "impact")))
    return _memories(spark, d).select("mem_no", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest"))


def quality(spark: SparkSession, d: str) -> DataFrame:
    """Technical details, vagueness and the reason to drop every record."""
    rows = dedup.quality(_memories(spark, d))
    return rows.select("mem_no", jstext.specificity(F.col("content")).cast("bigint").alias("details"), jstext.is_vague(F.col("content"), F.col("impact")).alias("vague"), "reason")


def quality_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records by the filter that drops them."""
    return dedup.quality(_memories(spark, d)).groupBy(F.coalesce("reason", F.lit("kept")).alias("stage")).agg(F.count("*").alias("n"))


def keyword_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The search words of every record's title and content, sorted."""
    text = F.concat_ws(" ", "title", "content")
    return _memories(spark, d).select("mem_no", F.array_join(F.array_sort(jstext.keywords(text)), "|").alias("words"))


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best records for a query by keywords and age."""
    found = search.hybrid(_memories(spark, d), search.words_of(spark, QUERY), AS_OF, limit=20)
    return found.select("mem_no", F.round("score", 6).alias("score"), F.round("keyword", 6).alias("keyword"), F.round("recency", 6).alias("recency"))


def _query_vector(entries: DataFrame) -> list[float]:
    """The vector of the lowest id that has a sound one of 64 numbers."""
    sound = entries.where("vector is not null and size(vector) = 64 and dimension = 64").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return list(sound.agg(F.min_by("vector", "id").alias("v")).first().v)


def vector_search(spark: SparkSession, d: str) -> DataFrame:
    """The 10 entries nearest to one entry's vector."""
    entries = table(spark, d, "vector_entries")
    sound = entries.where("vector is not null").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    one = sound.groupBy("id").agg(F.min("vector").alias("vector"))
    return search.vector_top(one, _query_vector(entries), 10).select("id", F.round("similarity", 6).alias("similarity"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best records for a query and a vector."""
    entries = table(spark, d, "vector_entries")
    sound = entries.where("vector is not null").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    query = F.array(*(F.lit(float(x)) for x in _query_vector(entries)))
    near = sound.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("q", query).select("id", search.cosine("vector", "q").alias("similarity"))
    found = search.hybrid(_memories(spark, d), search.words_of(spark, QUERY), AS_OF, near, limit=20)
    return found.select("mem_no", *(F.round(c, 6).alias(c) for c in ("score", "semantic", "keyword", "recency")))


def _sound_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, vector): one sound vector of every id."""
    entries = table(spark, d, "vector_entries")
    sound = entries.where("id is not null and vector is not null").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return sound.groupBy("id").agg(F.min("vector").alias("vector"))


def every_vector_search(spark: SparkSession, d: str) -> DataFrame:
    """The 10 entries nearest to each entry whose id, read as a number by its first seven digits, is divisible by 50."""
    one = _sound_vectors(spark, d)
    queries = one.where(F.conv(F.substring("id", 1, 7), 16, 10).cast("bigint") % 50 == 0)
    return search.many_vector_top(queries, one, 10).select("query", "id", F.round("similarity", 6).alias("similarity"))


def every_keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best records for the title of each record whose number is divisible by 50."""
    m = _memories(spark, d)
    queries = m.where("mem_no % 50 = 0 and title is not null").select(F.col("mem_no").alias("query"), F.col("title").alias("text"))
    found = search.many_keyword_top(queries, m, AS_OF, 20)
    return found.select("query", "mem_no", F.round("score", 6).alias("score"), F.round("keyword", 6).alias("keyword"))


def similar_records(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of class representatives of one type with similar contents."""
    sets = similarity.classes(similarity.shingle_sets(_memories(spark, d), "mem_no", "mem_type", "content"))
    pairs = similarity.similar_pairs(sets)
    return pairs.select("grp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("jaccard", 6).alias("jaccard"), F.round("contained", 6).alias("contained"))


def similar_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of every record: the lowest record of its type with the same shingles."""
    sets = similarity.shingle_sets(_memories(spark, d), "mem_no", "mem_type", "content").where(F.size("grams") > 0).withColumn("digest", F.md5(F.array_join(F.transform("grams", lambda g: g.cast("string")), ",")))
    reps = sets.groupBy(F.col("grp").alias("g"), F.col("digest").alias("h")).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    return sets.join(reps, F.col("grp").eqNullSafe(F.col("g")) & (F.col("digest") == F.col("h"))).select(F.col("id").alias("mem_no"), "rep", "copies")


def new_records(spark: SparkSession, d: str) -> DataFrame:
    """Incoming records that no stored record of their type repeats."""
    new, old = _arrivals(_memories(spark, d))
    return dedup.against(new, old, "mem_no").select("mem_no")


def todos_left(spark: SparkSession, d: str) -> DataFrame:
    """Records without todos that an anchor record of their conversation contains; backup copies are taken for decisions, so that some are."""
    backup = F.coalesce(F.startswith("file_path", F.lit("backup/")), F.lit(False))
    rows = _memories(spark, d).withColumn("mem_type", F.when(backup, "decision").otherwise(F.col("mem_type")))
    return dedup.without_repeated_todos(rows, "mem_no", "source_id").select("mem_no")


def commit_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Active records and commits whose score is 0.2 or more, with the band of the score."""
    memories = search.active(_memories(spark, d))
    pairs = linking.linked(linking.memory_bag(memories), linking.commit_bag(table(spark, d, "commits")), 0.2)
    band = F.when(F.col("score") >= linking.AUTO, "auto").when(F.col("score") >= linking.SUGGEST, "suggest").otherwise("weak")
    return pairs.select(F.col("a").alias("mem_no"), F.col("b").alias("commit_no"), linking.rounded(F.col("score")).alias("score"), band.alias("band"))


def write_actions(spark: SparkSession, d: str) -> DataFrame:
    """How many incoming records would be created or skipped, by path."""
    new, old = _arrivals(_memories(spark, d))
    at = lambda df: store.paths(df).join(df.select("mem_no", "content"), "mem_no")
    return store.write_actions(at(new), at(old)).groupBy("action").agg(F.count("*").alias("n"))


def import_plan(spark: SparkSession, d: str) -> DataFrame:
    """Which incoming records an import would take."""
    return store.import_plan(*_backup(_memories(spark, d))).select("mem_no", "import_action")


def index_state(spark: SparkSession, d: str) -> DataFrame:
    """Records without vector and vectors without record."""
    return store.index_state(_memories(spark, d), table(spark, d, "vector_entries"))


def listing(spark: SparkSession, d: str) -> DataFrame:
    """Conversations by source and whether records were extracted from them."""
    metas = table(spark, d, "conversation_meta").where("conv_id is not null").groupBy("conv_id").agg(F.min("source").alias("source"), F.max("turn_count").alias("turns"))
    done = _memories(spark, d).where("source_id is not null").groupBy(F.col("source_id").alias("conv_id")).agg(F.count("*").alias("records"))
    state = F.when(F.col("records").isNotNull(), "extracted").when(F.col("turns") > 0, "open").otherwise("empty")
    return metas.join(done, "conv_id", "left").groupBy("source", state.alias("state")).agg(F.count("*").alias("n"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk of every document, as length and digest."""
    return context.chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def degrees(memories: DataFrame) -> DataFrame:
    """(mem_no, degree) of the records that keyword edges join."""
    edges = stats.keyword_edges(memories)
    ends = edges.select(F.explode(F.array("a", "b")).alias("mem_no"))
    return ends.groupBy("mem_no").agg(F.count("*").alias("degree"))


def distinct_lists(memories: DataFrame) -> DataFrame:
    """(field, value): the types and authors that occur."""
    pairs = F.array(F.struct(F.lit("author").alias("field"), F.nullif("author", F.lit("")).alias("value")), F.struct(F.lit("type").alias("field"), F.col("mem_type").alias("value")))
    return memories.select(F.explode(pairs).alias("p")).select("p.field", "p.value").where("value is not null").distinct()


def due_conversations(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, turns): conversations with two or more recorded turns and no record yet."""
    metas = table(spark, d, "conversation_meta").where("conv_id is not null").groupBy("conv_id").agg(F.max("turn_count").alias("turns")).where("turns >= 2")
    done = _memories(spark, d).where("source_id is not null").select(F.col("source_id").alias("__s"))
    return metas.join(done, F.col("conv_id") == F.col("__s"), "left_anti")


def _on_memories(operator):
    return lambda spark, d: operator(_memories(spark, d))


QUERIES = {
    "proj05_conversation_text": conversation_text,
    "t01_cleaned": cleaned,
    "t05_redacted": redacted,
    "t05_chars": redacted_chars,
    "t07_trails": redaction_trails,
    "a08_redaction_hits": redaction_hits,
    "k05_titles": titles,
    "proj02_embed_texts": embed_texts,
    "d11_quality": quality,
    "a06_quality_counts": quality_counts,
    "r01_keywords": keyword_tokens,
    "r06_keyword_search": keyword_search,
    "r04_vector_search": vector_search,
    "r05_hybrid_search": hybrid_search,
    "r04_every_vector_search": every_vector_search,
    "r06_every_keyword_search": every_keyword_search,
    "j05_similar_records": similar_records,
    "j05_similar_classes": similar_classes,
    "d05_new_records": new_records,
    "d06_todos_left": todos_left,
    "j04_commit_candidates": commit_candidates,
    "k01_write_actions": write_actions,
    "j03_import_plan": import_plan,
    "j02_index_state": index_state,
    "a01_overview": _on_memories(stats.overview),
    "a02_conversations": _on_memories(stats.conversations),
    "a05_quality_report": _on_memories(stats.quality_report),
    "j08_same_conversation": _on_memories(stats.same_conversation),
    "j09_keyword_edges": _on_memories(stats.keyword_edges),
    "j10_commit_links": _on_memories(stats.commit_links),
    "r09_listing": listing,
    "r10_budget_prefix": _on_memories(stats.budget_prefix),
    "f09_recall": _on_memories(lambda m: context.recall(m, "retry budget", ("decision", "todo")).select("mem_no")),
    "f10_conversation": _on_memories(lambda m: context.in_conversation(m, "the").select("mem_no")),
    "f11_recent": _on_memories(lambda m: context.recent(m, AS_OF, 90).select("mem_no")),
    "f12_topic": _on_memories(lambda m: context.on_topic(m, "session cache").select("mem_no")),
    "f12_topic_fallback": _on_memories(lambda m: context.on_topic(m, "no such topic at all").select("mem_no")),
    "f05_due_conversations": due_conversations,
    "r08_snippets": _on_memories(lambda m: m.where("content is not null").select("mem_no", context.snippet(F.col("content"), "the").alias("snippet"))),
    "k06_entries": _on_memories(context.entries),
    "a15_distinct_lists": _on_memories(distinct_lists),
    "a17_degrees": _on_memories(degrees),
    "t02_chunks": chunks,
    "r12_stratified": lambda spark, d: stats.stratified(_memories(spark, d), "mem_type", "mem_no", 10),
}
SQL = oracle.build(RULES)
