"""Queries over listings, choices, renderings, reports and bundles, with the SQL that checks them."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import jstext
from skein.operators import bundle, dedup, extraction, linking, render, reports, scoring, search, stats, store
from skein.plans import library, oracle
from skein.plans.records import _each as nested_each
from skein.plans.oracle import ACTIVE, BACKUP, HAN, ID, KEY, QUALITY, SETS, WS, has, keywords, q, trim
from skein.runtime import table
from skein.sources import listing, records

NOW = datetime(2026, 7, 1, tzinfo=timezone.utc)
LATEST = "2026-01-01T00:00:00.000Z"


def on(name: str, operator):
    """The query that applies an operator to one table."""
    return lambda spark, d: operator(table(spark, d, name))


def _metas(spark: SparkSession, d: str) -> DataFrame:
    """One row per conversation: (conv_id, title, source, project, modified_at, turns) of the meta row with the lowest meta_no; turns is the highest count."""
    rows = table(spark, d, "conversation_meta").where("conv_id is not null")
    return rows.groupBy("conv_id").agg(*(F.min_by(c, "meta_no").alias(c) for c in ("title", "source", "project", "modified_at", "file_path")), F.max("turn_count").alias("turns"))


META = """m AS (SELECT conv_id, arg_min(title, meta_no) FILTER (WHERE true) AS t0, max(turn_count) AS turns, min(meta_no) AS k FROM conversation_meta WHERE conv_id IS NOT NULL GROUP BY 1),
  metas AS (SELECT m.conv_id, c.title, c.source, c.project, c.modified_at, c.file_path, m.turns FROM m JOIN conversation_meta c ON c.meta_no = m.k)"""


def ignored(spark: SparkSession, d: str) -> DataFrame:
    """Conversations without those of which a record's source id, or the title of one, is on the ignore list (titles of records from backups)."""
    names = table(spark, d, "memories").where(F.startswith("file_path", F.lit("backup/"))).select(F.explode(F.array("source_id", "source_title")).alias("name"))
    return extraction.without_ignored(_metas(spark, d), names).select("conv_id")


def modified(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with modified_ms where modified_at is in milliseconds or an ISO instant."""
    at = F.col("modified_at")
    ms = F.when(at.rlike(r"^\d{13}$"), at.try_cast("bigint")).when(at.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"), F.floor(F.unix_micros(at.try_cast("timestamp")) / 1000).cast("bigint"))
    return _metas(spark, d).withColumn("modified_ms", ms)


def incremental(spark: SparkSession, d: str) -> DataFrame:
    """Conversations to extract again: every recorded conversation counts as processed at one instant, and its files as those outside the backup."""
    m = table(spark, d, "memories").where("source_id is not null")
    state = m.select(F.col("source_id").alias("conv_id")).distinct().withColumn("processed_ms", F.lit(1_735_689_600_000))
    files = m.select("source_id", F.col("file_path").alias("path"))
    existing = files.where(~F.startswith("path", F.lit("backup/"))).select("path")
    return extraction.incremental(modified(spark, d), state, files, existing).select("conv_id")


def long_enough(spark: SparkSession, d: str) -> DataFrame:
    """What happens to every conversation by its number of turns, a third of the recorded ones being known already."""
    m = _metas(spark, d)
    return extraction.long_enough(m.select("conv_id", "turns"), m.where("turns % 3 = 0").select("conv_id", F.col("turns").alias("turn_count")), 4).select("conv_id", "action")


def digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest, n_chars) of a text column."""
    return df.select(key, F.md5(text).alias("digest"), F.length(text).cast("bigint").alias("n_chars"))


def manifest(memories: DataFrame) -> DataFrame:
    """(source_id, path): which files the records of a conversation are in."""
    return memories.where("source_id is not null and file_path is not null").select("source_id", F.col("file_path").alias("path")).distinct()


def edges_visible(memories: DataFrame) -> DataFrame:
    """The keyword edges between two decisions."""
    return reports.visible_edges(stats.keyword_edges(memories), reports.filtered(memories, ("decision",)))


def index_updates(spark: SparkSession, d: str) -> DataFrame:
    """(id, action) that bring the vectors of one model up to date: add, or drop."""
    return store.index_updates(table(spark, d, "memories"), table(spark, d, "vector_entries"), MODEL)


MODEL = "embed-base-v2"


def new_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of 0.2 or more (the default is 0.40, which few rows of small tables reach) between active records and commits that a record does not name yet, with the paths they would keep."""
    memories, commits = search.active(table(spark, d, "memories")), table(spark, d, "commits")
    return linking.new_links(memories, commits, 0.2).select("mem_no", "commit_no", "score", "band", F.size("paths").alias("n_paths"))


def written_back(memories: DataFrame) -> DataFrame:
    """Records rendered as Markdown and read again."""
    kept = memories.where("mem_date rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' and title is not null and content is not null and not contains(content, '**') and not contains(title, '\n') and not contains(title, '\r')")
    kept = kept.where("trim(title) <> '' and trim(content) <> ''").withColumn("context", F.lit(None).cast("string")).withColumn("reasoning", F.lit(None).cast("string")).withColumn("alternatives", F.lit(None).cast("string")).withColumn("impact", F.lit(None).cast("string"))
    texts = records.rendered(kept).select(F.concat(F.lit("store/x/"), F.col("mem_no").cast("string"), F.lit(".md")).alias("path"), "raw")
    read = records.markdown(texts)
    return read.select(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("bigint").alias("mem_no"), "title", "mem_date", "status", F.md5(jstext.trim(F.col("content"))).alias("digest"))


def file_logs(commits: DataFrame) -> DataFrame:
    """Commits as records of a file's log, read again."""
    letter = F.coalesce(*(F.when(F.col("change_kind") == v, k) for k, v in listing.CHANGES.items()), F.lit("T"))
    moved = F.when(F.col("from_path").isNotNull() & letter.isin("R", "C"), F.concat(letter, F.lit("100\t"), "from_path", F.lit("\tx"))).otherwise(F.concat(letter, F.lit("\tx")))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    record = F.concat_ws("\n", F.concat_ws("\t", blank("full_sha"), blank("commit_date"), blank("author"), blank("subject")), moved)
    return listing.file_log(commits.where("not contains(coalesce(subject, ''), '\n')").select(record.alias("record"))).groupBy("change_kind").agg(F.count("*").alias("n"), F.count("from_path").alias("moved"), F.countDistinct("sha").alias("shas"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Records as answers of a model, one fenced list each, parsed again; those of unknown type or without a field are dropped."""
    m = table(spark, d, "memories")
    kind = F.when(F.col("mem_no") % 7 == 0, "guess").otherwise(F.col("mem_type"))
    one = F.to_json(F.array(F.struct(kind.alias("type"), "title", "content", "impact")))
    answer = F.when(F.col("mem_no") % 11 == 0, F.concat(F.lit("no list "), one)).when(F.col("mem_no") % 2 == 0, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).otherwise(one)
    return extraction.parsed_results(m.select("mem_no", answer.alias("answer"))).select("mem_no", "mem_type", F.md5("content").alias("digest"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Whether a record's content keeps the words of its title."""
    rows = table(spark, d, "memories").where("title is not null").select("mem_no", "mem_type", "title", "content")
    return reports.evidence(rows, reports.key_tokens(F.col("title")), reports.searchable("content"))


def _fixtures(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Records outside the backup as expectations (the first two words of their titles), all records as what was extracted, by conversation and day."""
    m = table(spark, d, "memories").where("source_id is not null and title is not null")
    fixture = F.concat_ws("/", "source_id", "mem_date").alias("fixture_id")
    expected = m.where(~F.coalesce(F.startswith("file_path", F.lit("backup/")), F.lit(False))).select(fixture, F.col("mem_no").alias("pos"), "mem_type", F.slice(F.filter(F.split("title", " "), lambda w: w != ""), 1, 2).alias("must"), F.lit(None).cast("array<string>").alias("must_not"))
    return expected, m.select(fixture, F.col("mem_no").alias("pos"), "mem_type", "title", F.concat_ws(" ", "title", "content").alias("text"))


def fixtures_scored(spark: SparkSession, d: str) -> DataFrame:
    """The scores of every conversation and day as a fixture."""
    expected, extracted = _fixtures(spark, d)
    fixtures = expected.select("fixture_id").unionByName(extracted.select("fixture_id")).distinct().withColumn("error", F.lit(None).cast("string"))
    return reports.by_fixture(scoring.matches(expected, extracted), fixtures)


def import_counts(memories: DataFrame) -> DataFrame:
    """What importing the backup copies into the other records would do, by author."""
    backup = F.coalesce(F.startswith("file_path", F.lit("backup/")), F.lit(False))
    return bundle.take_over(memories.where(backup), memories.where(~backup))


def first_node(memories: DataFrame) -> DataFrame:
    """The records of the lowest node id."""
    lowest = memories.agg(F.min(jstext.node_id(F.col("mem_type"), F.col("mem_date"), F.col("title")))).first()[0]
    return reports.by_node(memories, lowest).select("mem_no")


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Rows and conversations of every source, over messages and listings."""
    rows = table(spark, d, "chat_messages").select("source", "conv_id").unionByName(table(spark, d, "conversation_meta").select("source", "conv_id"))
    return rows.where("conv_id is not null").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"))


def enabled_sources(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of the sources that a configuration leaves on."""
    config = {"sources": {"windsurf": {"enabled": False}}}
    return _metas(spark, d).where(F.col("source").isin(*(s for s in bundle.SOURCES if extraction.enabled(config, s)))).select("conv_id")


def within_extractions(memories: DataFrame) -> DataFrame:
    """Records that stay of those that one extraction gave: one conversation on one day."""
    runs = memories.where("source_id is not null and mem_date is not null").withColumn("run", F.concat_ws("/", "source_id", "mem_date"))
    return dedup.within(runs, "run", "mem_no").select("mem_no")


QUERIES = {
    "f01_not_ignored": ignored,
    "f02_picked": lambda s, d: extraction.picked(_metas(s, d), "1,3, 7,100000").select("conv_id"),
    "f03_prefix": lambda s, d: extraction.with_prefix(_metas(s, d), "A").select("conv_id"),
    "f04_since": lambda s, d: extraction.since(modified(s, d), "52 weeks ago", NOW).select("conv_id"),
    "f05_incremental": incremental,
    "f06_turn_actions": long_enough,
    "f07_filtered": on("memories", lambda m: reports.filtered(search.active(m), ("decision", "todo"), author="aurelio-mirandolo").select("mem_no")),
    "f08_dashboard": on("memories", lambda m: reports.filtered(m, (), None, "active", "cache").select("mem_no")),
    "f13_focus": on("memories", lambda m: reports.focused(m, "retry").select("mem_no")),
    "f14_answers": answers,
    "f15_rule_subset": on("memories", lambda m: render.rule_subset(m).select("mem_no")),
    "f18_enabled": enabled_sources,
    "f19_visible_edges": on("memories", edges_visible),
    "f19_page": on("memories", lambda m: reports.page(m, 2, 25).select("mem_no")),
    "s04_line_counts": on("turn_exports", lambda t: listing.line_counts(t, "file_id", "raw")),
    "s06_titles": lambda s, d: listing.with_titles(_metas(s, d).select("conv_id", "title"), table(s, d, "memories").select(F.col("source_id").alias("conv_id"), F.col("source_title").alias("title"))),
    "s08_of_folder": lambda s, d: listing.of_folder(_metas(s, d).withColumn("folder", F.regexp_replace("file_path", "[/.]", "-")), "/work/nowhere/cursor", "folder").select("conv_id"),
    "s10_titles": on("chat_messages", lambda m: listing.titled(m, "conv_id", ["msg_id"], 24)),
    "s12_session_turns": on("copilot_files", lambda f: listing.session_turns(f).select("file_id", "request_ord", "role", F.md5("text").alias("digest"))),
    "s13_session_listing": on("copilot_files", listing.session_listing),
    "s16_lookup": lambda s, d: listing.lookup(_metas(s, d), _metas(s, d).agg(F.min("conv_id")).first()[0]).select("conv_id", "turns"),
    "s17_sources": sources,
    "s18_store_files": on("memories", lambda m: listing.store_files(m).select("mem_no", "folder_type", "folder_author")),
    "s19_written_back": on("memories", written_back),
    "s20_bundle_errors": on("memories", lambda m: m.select("mem_no", bundle.first_error().alias("error")).where("error is not null")),
    "s21_file_log": on("commits", file_logs),
    "k02_manifest": on("memories", manifest),
    "k03_alive": on("memories", lambda m: manifest(m).join(manifest(m).where("not startswith(path, 'backup/')").select("path").distinct(), "path", "left_semi").select("source_id").distinct()),
    "k06_export": on("memories", lambda m: bundle.entries(m, ("decision", "convention")).select("mem_no", "context", "source_title", "status")),
    "p01_records": on("memories", lambda m: bundle.records(bundle.entries(m, resolved=True)).select("mem_no", "context", "source_title", "status")),
    "k07_import": on("memories", import_counts),
    "k08_notes": on("memories", lambda m: render.notes(m).select("mem_no", "path", F.md5("raw").alias("digest"))),
    "k10_rule_entries": on("memories", lambda m: render.sections(m).select("section", "mem_no", F.md5("entry").alias("digest"))),
    "k12_skill_entries": on("memories", lambda m: render.skill_rows(m).select("skill", "mem_no", F.md5("entry").alias("digest"))),
    "k13_context": on("memories", lambda m: render.context_rows(m).select("rank", "mem_date", "mem_no", F.md5("entry").alias("digest"))),
    "k14_index": on("memories", lambda m: m.select("mem_no", render.index_line().alias("line"))),
    "k18_links_kept": on("memories", lambda m: render.without_auto_links(m).where("links is not null").select("mem_no", F.size("links.implementations").alias("n"))),
    "k19_resolved": on("memories", lambda m: store.resolve(m, "cache").where("changed").select("mem_no", "status")),
    "k20_vacuumed": on("memories", lambda m: store.vacuumed(manifest(m), m.where("not coalesce(startswith(file_path, 'backup/'), false)").select(F.col("file_path").alias("path")))),
    "k23_copied": on("memories", lambda m: digests(render.copied(m), "mem_no", "text")),
    "p07_display": on("memories", lambda m: digests(render.display(m), "mem_no", "text")),
    "p05_turn_texts": on("chat_messages", lambda m: extraction.turn_texts(m).select("msg_id", F.md5("line").alias("digest"))),
    "p09_folders": on("conversation_meta", lambda m: m.select("meta_no", listing.display_folder(F.col("file_path"), F.col("source")).alias("folder"))),
    "a01_newest": on("memories", lambda m: reports.newest(m).select("mem_no")),
    "a02_types": on("memories", reports.conversation_types),
    "a04_cards": on("memories", reports.conversation_records),
    "a05_pair_counts": on("memories", reports.pair_counts),
    "a05_summary": on("memories", reports.quality_summary),
    "a05_vague_samples": on("memories", lambda m: reports.vague_samples(m).select("mem_no", "content")),
    "a10_fixtures": fixtures_scored,
    "a11_misses": lambda s, d: reports.misses(*_fixtures(s, d)).select("fixture_id", "pos", "hits", "needed", "same_type"),
    "a12_evidence": lambda s, d: scored(s, d).select("mem_no", F.size("matched").alias("matched"), F.size("missed").alias("missed"), "full", "partial"),
    "a13_evidence_by_type": lambda s, d: reports.evidence_by_type(scored(s, d), "mem_type"),
    "a14_checks": on("memories", reports.checks),
    "t09_key_tokens": on("memories", lambda m: m.select("mem_no", F.array_join(F.array_sort(reports.key_tokens(F.col("content"))), "|").alias("tokens"))),
    "t12_width": on("memories", lambda m: m.where("title is not null").select("mem_no", reports.display_width(F.col("title")).cast("bigint").alias("width"))),
    "t08_sanitised": on("chat_messages", lambda m: m.where("text is not null").select("msg_id", F.length(jstext.sanitised(F.col("text"))).cast("bigint").alias("n_chars"))),
    "r09_conversations": lambda s, d: reports.listing(table(s, d, "conversation_meta"), table(s, d, "memories")),
    "r11_tiers": on("memories", lambda m: render.tiered(m).select("tier", "mem_no")),
    "j04_new_links": new_links,
    "j11_history": lambda s, d: reports.file_history(table(s, d, "memories"), table(s, d, "commits")),
    "j13_by_node": on("memories", first_node),
    "w06_index_updates": index_updates,
    "d03_within_extractions": on("memories", within_extractions),
    "d04_reindex": on("memories", dedup.reindex),
}


B = lambda c: f"coalesce({c}, '')"
GIVEN = lambda c, lead: f"CASE WHEN {B(c)} <> '' THEN {q(lead)} || {c} END"
NL = "chr(10)"
CLEAN = lambda c: trim(f"replace({c}, chr(13) || chr(10), chr(10))")
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
MS = f"CASE WHEN regexp_matches(modified_at, {q('^[0-9]{13}$')}) THEN TRY_CAST(modified_at AS BIGINT) WHEN regexp_matches(modified_at, {q(ISO)}) THEN epoch_ms(TRY_CAST(modified_at AS TIMESTAMPTZ)) END"
TITLE = lambda t: f"(SELECT CASE WHEN length(f) > 60 THEN substring(f, 1, 57) || '...' ELSE f END FROM (SELECT {trim(f'regexp_replace({t}, {q('[' + WS + ']+')}, chr(32), {q('g')})')} AS f))"
NODE = f"substring(regexp_replace(coalesce(mem_type, '') || ':' || coalesce(mem_date, '') || ':' || coalesce(title, ''), '[^a-zA-Z0-9:{HAN}\\-]', '_', 'g'), 1, 120)"
RANK = "CASE mem_type WHEN 'architecture' THEN 0 WHEN 'decision' THEN 1 WHEN 'convention' THEN 2 WHEN 'todo' THEN 3 WHEN 'issue' THEN 4 END"
ENTRY = f"""CASE mem_type WHEN 'todo' THEN '- [ ] **' || {B('title')} || '**' || CASE WHEN {B('content')} <> {B('title')} THEN ' — ' || {B('content')} ELSE '' END
  WHEN 'convention' THEN '- **' || {B('title')} || '**: ' || {B('content')}
  ELSE concat_ws({NL} || '  ', '- **' || {B('title')} || '** _(' || {B('mem_date')} || ')_', {B('content')}, {GIVEN('reasoning', 'Why: ')}, {GIVEN('alternatives', 'Rejected: ')}, {GIVEN('impact', 'Affects: ')}) END"""
JOINT = f"{NL} || {NL}"
CLEANED = f"concat_ws({JOINT}, '## ' || {trim(B('title'))}, {CLEAN(B('content'))}, CASE WHEN {B('reasoning')} <> '' THEN 'Why: ' || {CLEAN('reasoning')} END, CASE WHEN {B('alternatives')} <> '' THEN 'Rejected: ' || {CLEAN('alternatives')} END)"
STOP = ", ".join(q(w) for w in reports.ANSWER_STOPWORDS)
TOKENS = lambda c: f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({B(c)}), '[^\\p{{L}}\\p{{N}}\\-{WS}]+', ' ', 'g'), '[{WS}]+'), lambda w: length(w) >= 3 AND w NOT IN ({STOP})))"
EVIDENCE = f"""e AS (SELECT mem_no, mem_type, len(t) AS n, len(list_filter(t, lambda w: contains(x, w))) AS hit FROM (SELECT mem_no, mem_type, {TOKENS('title')} AS t, lower({B('content')}) AS x FROM memories WHERE title IS NOT NULL)),
  v AS (SELECT *, hit = n AS fulls, hit < n AND 2 * hit >= n AS partials FROM e)"""
FIXTURE = "concat_ws('/', source_id, mem_date)"
FIX = f"""e AS (SELECT {FIXTURE} AS fixture_id, mem_no AS pos, mem_type, list_filter(string_split(title, ' '), lambda w: w <> '')[1:2] AS must FROM memories WHERE source_id IS NOT NULL AND title IS NOT NULL AND NOT {BACKUP}),
  x AS (SELECT {FIXTURE} AS fixture_id, mem_no AS pos, mem_type, lower(concat_ws(' ', title, content)) AS text FROM memories WHERE source_id IS NOT NULL AND title IS NOT NULL)"""
PAIRS = f"""{SETS}, pr AS (SELECT x.grp, x.id AS a, y.id AS b, x.grams AS ga, y.grams AS gb, len(list_intersect(x.grams, y.grams)) AS s FROM sets x JOIN sets y ON x.grp IS NOT DISTINCT FROM y.grp AND x.id < y.id),
  jc AS (SELECT a, b, CASE WHEN len(ga) = 0 AND len(gb) = 0 THEN 1 ELSE s / (len(ga) + len(gb) - s) END AS j, CASE WHEN least(len(ga), len(gb)) = 0 THEN 1 ELSE s / least(len(ga), len(gb)) END AS c FROM pr),
  rs AS (SELECT a, b, CASE WHEN j > 0.55 THEN 'duplicate' WHEN c > 0.75 THEN 'subsumed' END AS reason FROM jc)"""
SESSION = """c AS (SELECT file_id, 0 AS n, raw AS j FROM copilot_files WHERE json_valid(raw)
    UNION ALL SELECT file_id, n, j FROM (SELECT file_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS j FROM (SELECT file_id, string_split(raw, chr(10)) AS l FROM copilot_files WHERE NOT coalesce(json_valid(raw), true))) WHERE json_valid(j)),
  s AS (SELECT file_id, n, CASE WHEN json_type(j) = 'OBJECT' AND j ->> '$.kind' = '0' AND json_type(j, '$.v') = 'OBJECT' THEN json_extract(j, '$.v') ELSE j::JSON END AS v FROM c),
  t AS (SELECT file_id, arg_max(v, n) AS v FROM s WHERE json_type(v) = 'OBJECT' AND v ->> '$.sessionId' IS NOT NULL GROUP BY 1)"""

REQUESTS = f"{SESSION}, q AS ({nested_each('t', 'file_id', chr(106) + 'son_extract(v, ' + q('$.requests') + ')', 'i')}), p AS ({nested_each('q', 'file_id, i', 'json_extract(e, ' + q('$.response') + ')', 'j')})"
ASKED = trim("coalesce(e ->> '$.message.text', CASE WHEN json_type(e, '$.message') <> 'OBJECT' THEN e ->> '$.message' END)")
PLAIN = "CASE WHEN json_type(e, '$.value') <> 'OBJECT' THEN e ->> '$.value' END"
ROOM = len(render.context_text([])) + sum(len("### " + h) + 2 for h in render.HEADINGS["en"].values())

SQL = {
    "f01_not_ignored": f"WITH {META}, i AS (SELECT source_id AS n FROM memories WHERE {BACKUP} UNION SELECT source_title FROM memories WHERE {BACKUP}) SELECT conv_id FROM metas WHERE NOT EXISTS (SELECT 1 FROM i WHERE n = conv_id OR n = title)",
    "f02_picked": f"WITH {META}, r AS (SELECT conv_id, row_number() OVER (ORDER BY modified_at DESC NULLS LAST, conv_id) AS p FROM metas) SELECT conv_id FROM r WHERE p IN (1, 3, 7, 100000)",
    "f03_prefix": f"WITH {META} SELECT conv_id FROM metas WHERE starts_with(lower(conv_id), 'a')",
    "f04_since": f"WITH {META} SELECT conv_id FROM metas WHERE {MS} >= {int(NOW.timestamp() * 1000) - 52 * 7 * 86_400_000}",
    "f05_incremental": f"""WITH {META}, o AS (SELECT DISTINCT source_id FROM memories WHERE source_id IS NOT NULL), f AS (SELECT DISTINCT source_id FROM memories WHERE source_id IS NOT NULL AND file_path IS NOT NULL AND NOT starts_with(file_path, 'backup/'))
        SELECT conv_id FROM metas WHERE conv_id NOT IN (SELECT source_id FROM o) OR {MS} > 1735689600000 OR conv_id NOT IN (SELECT source_id FROM f)""",
    "f06_turn_actions": f"WITH {META} SELECT conv_id, CASE WHEN coalesce(turns, 0) < 4 THEN 'mark' WHEN turns % 3 = 0 THEN 'skip' ELSE 'process' END AS action FROM metas",
    "f07_filtered": f"SELECT mem_no FROM memories WHERE {ACTIVE} AND mem_type IN ('decision', 'todo') AND author = 'aurelio-mirandolo'",
    "f08_dashboard": f"SELECT mem_no FROM memories WHERE coalesce(status, 'active') = 'active' AND {has('cache', 'title', 'content', 'context')}",
    "f13_focus": f"SELECT mem_no FROM memories WHERE {has('retry', 'title', 'content', 'impact')}",
    "f14_answers": "SELECT mem_no, mem_type, md5(content) AS digest FROM memories WHERE mem_no % 7 <> 0 AND mem_no % 11 <> 0 AND mem_type IN ('decision', 'architecture', 'convention', 'todo', 'issue') AND coalesce(title, '') <> '' AND coalesce(content, '') <> ''",
    "f15_rule_subset": f"SELECT mem_no FROM memories WHERE mem_type IN ('convention', 'decision') AND {ACTIVE}",
    "f18_enabled": f"WITH {META} SELECT conv_id FROM metas WHERE source IN ('cursor', 'claude-code', 'copilot', 'codex')",
    "f19_visible_edges": f"WITH k AS (SELECT mem_no FROM memories WHERE mem_type = 'decision') SELECT a, b FROM ({library.SQL['j09_keyword_edges']}) WHERE a IN (SELECT mem_no FROM k) AND b IN (SELECT mem_no FROM k)",
    "f19_page": "SELECT mem_no FROM memories ORDER BY coalesce(mem_date, '') DESC, mem_no LIMIT 25 OFFSET 25",
    "s04_line_counts": """SELECT file_id, count(*) FILTER (WHERE contains(raw, '"role"'))::BIGINT AS turns FROM turn_exports GROUP BY 1""",
    "s06_titles": f"WITH {META}, o AS (SELECT source_id, min(source_title) AS t FROM memories WHERE source_title <> '' GROUP BY 1) SELECT conv_id, coalesce(t, title) AS title FROM metas LEFT JOIN o ON source_id = conv_id",
    "s08_of_folder": f"WITH {META}, f AS (SELECT conv_id, lower(regexp_replace(file_path, '[/.]', '-', 'g')) AS n FROM metas), h AS (SELECT conv_id FROM f WHERE contains(n, '-cursor') OR ends_with(n, '-work-nowhere-cursor')) SELECT conv_id FROM h UNION ALL SELECT conv_id FROM f WHERE NOT EXISTS (SELECT 1 FROM h)",
    "s10_titles": f"SELECT conv_id, coalesce((SELECT CASE WHEN length(f) > 60 THEN substring(f, 1, 57) || '...' ELSE f END FROM (SELECT {trim(f'regexp_replace(t, {q('[' + WS + ']+')}, chr(32), {q('g')})')} AS f)), substring(conv_id, 1, 24)) AS title FROM (SELECT conv_id, arg_min(text, msg_id) FILTER (WHERE role = 'user' AND {trim(B('text'))} <> '') AS t FROM chat_messages WHERE conv_id IS NOT NULL GROUP BY 1)",
    "s12_session_turns": f"""WITH {REQUESTS}, u AS (SELECT file_id, i, x FROM (SELECT file_id, i, {ASKED} AS x FROM q) WHERE x <> '' AND NOT starts_with(x, '/')),
        r AS (SELECT file_id, i, j, CASE WHEN e ->> '$.kind' = 'markdownContent' THEN coalesce(e ->> '$.value.value', {PLAIN}) WHEN e ->> '$.kind' IS NULL THEN coalesce({PLAIN}, e ->> '$.result.value') END AS x FROM p),
        a AS (SELECT file_id, i, {trim('string_agg(x, chr(10) ORDER BY j)')} AS x FROM r WHERE x IS NOT NULL GROUP BY 1, 2)
        SELECT file_id, i AS request_ord, 'user' AS role, md5(x) AS digest FROM u UNION ALL SELECT a.file_id, a.i, 'assistant', md5(a.x) FROM a JOIN u USING (file_id, i) WHERE a.x <> ''""",
    "s13_session_listing": f"""WITH {REQUESTS}, u AS (SELECT file_id, i, {ASKED} AS x FROM q), n AS (SELECT file_id, max(i) AS last FROM q GROUP BY 1),
        f AS (SELECT file_id, arg_min(x, i) AS x FROM u WHERE i < 3 AND x <> '' AND NOT starts_with(x, '/') GROUP BY 1), g AS (SELECT file_id, {trim('regexp_replace(x, ' + q('[' + WS + ']+') + ", ' ', 'g')")} AS x FROM f)
        SELECT t.file_id, (2 * (coalesce(last, -1) + 1))::INT AS turns, coalesce(CASE WHEN length(g.x) > 60 THEN substring(g.x, 1, 57) || '...' ELSE g.x END, substring(t.v ->> '$.sessionId', 1, 8)) AS title FROM t LEFT JOIN n USING (file_id) LEFT JOIN g USING (file_id)""",
    "r11_tiers": f"""WITH r AS (SELECT mem_no, {B('mem_date')} AS mem_date, length({ENTRY}) + 2 AS size FROM memories WHERE {RANK} IS NOT NULL), w AS (SELECT sum(size) AS whole FROM r),
        o AS (SELECT mem_no, sum(size) OVER (ORDER BY mem_date DESC, mem_no ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (ORDER BY mem_date DESC, mem_no) AS place FROM r),
        f AS (SELECT mem_no FROM o, w WHERE whole + {ROOM} <= {render.CONTEXT_CHARS} OR total + {ROOM} <= {render.CONTEXT_CHARS - render.INDEX_CHARS} OR place = 1)
        SELECT 'full' AS tier, mem_no FROM f UNION ALL SELECT 'index', mem_no FROM memories, w WHERE mem_no NOT IN (SELECT mem_no FROM f) AND whole + {ROOM} > {render.CONTEXT_CHARS}""",
    "j04_new_links": f"""WITH s AS (SELECT a.mem_no, a.commit_no, a.score FROM ({library.SQL['j04_commit_candidates']}) a), k AS (SELECT DISTINCT mem_no, x.sha AS sha FROM (SELECT mem_no, unnest(links.implementations) AS x FROM memories)),
        m AS (SELECT id AS mem_no, list(token) AS words FROM ({oracle.MEM_BAG}) GROUP BY 1), n AS (SELECT s.*, c.paths, m.words FROM s JOIN commits c USING (commit_no) JOIN m USING (mem_no) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.mem_no = s.mem_no AND k.sha = c.full_sha)),
        h AS (SELECT *, len(list_filter(paths, lambda p: list_has_any({keywords("regexp_replace(p, '[/\\\\._-]', ' ', 'g')")}, words))) AS hit FROM n)
        SELECT mem_no, commit_no, score, CASE WHEN score >= 0.7 THEN 'auto' ELSE 'suggest' END AS band, (CASE WHEN hit > 0 THEN hit ELSE least(len(paths), 5) END)::INT AS n_paths FROM h""",
    "s16_lookup": "SELECT conv_id, max(turn_count) AS turns FROM conversation_meta WHERE conv_id = (SELECT min(conv_id) FROM conversation_meta) GROUP BY 1",
    "s17_sources": "SELECT source, count(*)::BIGINT AS n, count(DISTINCT conv_id)::BIGINT AS conversations FROM (SELECT source, conv_id FROM chat_messages UNION ALL SELECT source, conv_id FROM conversation_meta) WHERE conv_id IS NOT NULL GROUP BY 1",
    "s18_store_files": """SELECT mem_no, k AS folder_type, CASE WHEN k IS NOT NULL THEN p[len(p) - 2] END AS folder_author FROM (SELECT mem_no, p, CASE WHEN ends_with(file_path, '.md') AND len(list_filter(p, lambda x: starts_with(x, '.'))) = 0 THEN
        CASE WHEN p[len(p) - 1] IN ('decision', 'architecture', 'convention', 'todo', 'issue') THEN p[len(p) - 1] WHEN p[len(p) - 1] IN ('decisions', 'conventions', 'todos', 'issues') THEN rtrim(p[len(p) - 1], 's') END END AS k FROM (SELECT mem_no, file_path, string_split(file_path, '/') AS p FROM memories))""",
    "s19_written_back": f"""SELECT mem_no, {trim('title')} AS title, mem_date, CASE WHEN status = 'resolved' THEN 'resolved' ELSE 'active' END AS status, md5({trim('replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))')}) AS digest FROM memories
        WHERE regexp_full_match(mem_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND title IS NOT NULL AND content IS NOT NULL AND NOT contains(content, '**') AND NOT contains(title, chr(10)) AND NOT contains(title, chr(13)) AND trim(title, ' ') <> '' AND trim(content, ' ') <> ''""",
    "s20_bundle_errors": """SELECT * FROM (SELECT mem_no, CASE WHEN NOT coalesce(mem_type IN ('decision', 'architecture', 'convention', 'todo', 'issue'), false) THEN 'type' WHEN coalesce(title, '') = '' THEN 'title' WHEN coalesce(content, '') = '' THEN 'content'
        WHEN NOT coalesce(regexp_full_match(mem_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), false) THEN 'date' WHEN coalesce(source_id, '') = '' THEN 'sourceId' WHEN NOT coalesce(source_type IN ('cursor', 'claude-code', 'windsurf', 'copilot', 'codex'), false) THEN 'sourceType' END AS error FROM memories) WHERE error IS NOT NULL""",
    "s21_file_log": """SELECT CASE WHEN change_kind IN ('added', 'modified', 'deleted', 'renamed', 'copied') THEN change_kind ELSE 'other' END AS change_kind, count(*)::BIGINT AS n, count(*) FILTER (WHERE coalesce(from_path, '') <> '' AND change_kind IN ('renamed', 'copied'))::BIGINT AS moved, count(DISTINCT coalesce(full_sha, ''))::BIGINT AS shas
        FROM commits WHERE NOT contains(coalesce(subject, ''), chr(10)) GROUP BY 1""",
    "k02_manifest": "SELECT DISTINCT source_id, file_path AS path FROM memories WHERE source_id IS NOT NULL AND file_path IS NOT NULL",
    "k03_alive": "SELECT DISTINCT source_id FROM memories WHERE source_id IS NOT NULL AND file_path IS NOT NULL AND NOT starts_with(file_path, 'backup/')",
    "k06_export": f"SELECT mem_no, nullif(context, '') AS context, nullif(source_title, '') AS source_title, 'active' AS status FROM memories WHERE {ACTIVE} AND mem_type IN ('decision', 'convention')",
    "p01_records": "SELECT mem_no, coalesce(context, '') AS context, coalesce(source_title, '') AS source_title, CASE WHEN status = 'resolved' THEN 'resolved' ELSE 'active' END AS status FROM memories",
    "k07_import": f"WITH b AS (SELECT author, {KEY} AS k, {BACKUP} AS fresh FROM memories) SELECT coalesce(nullif(author, ''), 'unknown') AS author, CASE WHEN k IN (SELECT k FROM b WHERE NOT fresh) THEN 'skip' ELSE 'create' END AS action, count(*)::BIGINT AS n FROM b WHERE fresh GROUP BY 1, 2",
    "k08_notes": f"""SELECT mem_no, {B('mem_type')} || '/' || {B('mem_date')} || '-' || substring(regexp_replace(regexp_replace({B('title')}, '[<>:"/\\\\|?*]', '', 'g'), '[{WS}]+', '-', 'g'), 1, 80) || '.md' AS path,
        md5(concat_ws({NL}, '---', 'type: ' || {B('mem_type')}, 'date: ' || {B('mem_date')}, 'status: ' || coalesce(status, 'active'), {GIVEN('author', 'author: ')}, 'tags: [skein, ' || {B('mem_type')} || ']', '---') || {JOINT} ||
        concat_ws({JOINT}, '# ' || {B('title')}, CASE WHEN {B('context')} <> '' THEN '## Context' || {NL} || context END, '## Content' || {NL} || {B('content')}, CASE WHEN {B('reasoning')} <> '' THEN '## Reasoning' || {NL} || reasoning END, CASE WHEN {B('alternatives')} <> '' THEN '## Alternatives' || {NL} || alternatives END, CASE WHEN {B('impact')} <> '' THEN '## Impact' || {NL} || impact END) || {NL}) AS digest FROM memories""",
    "k10_rule_entries": f"SELECT CASE mem_type WHEN 'convention' THEN 0 ELSE 1 END AS section, mem_no, md5(concat_ws({JOINT}, '## ' || {B('title')}, {B('content')}, {GIVEN('reasoning', 'Why: ')}, {GIVEN('alternatives', 'Rejected alternatives: ')})) AS digest FROM memories WHERE mem_type IN ('convention', 'decision') AND {ACTIVE}",
    "k12_skill_entries": f"SELECT 'project-' || CASE mem_type WHEN 'architecture' THEN 'architecture' ELSE mem_type || 's' END AS skill, mem_no, md5({CLEANED}) AS digest FROM memories WHERE mem_type IN ('convention', 'architecture') OR (mem_type = 'decision' AND {ACTIVE})",
    "k13_context": f"SELECT {RANK} AS rank, {B('mem_date')} AS mem_date, mem_no, md5({ENTRY}) AS digest FROM memories WHERE {RANK} IS NOT NULL",
    "k14_index": f"SELECT mem_no, '- [' || CASE mem_type WHEN 'decision' THEN 'D' WHEN 'architecture' THEN 'A' WHEN 'convention' THEN 'C' WHEN 'todo' THEN 'T' WHEN 'issue' THEN 'I' ELSE '?' END || '] ' || {B('title')} || ' _(' || {B('mem_date')} || ')_' AS line FROM memories",
    "k18_links_kept": "SELECT mem_no, n FROM (SELECT mem_no, len(list_filter(links.implementations, lambda x: x.confirmed_by IS DISTINCT FROM 'auto'))::INT AS n FROM memories) WHERE n > 0",
    "k19_resolved": f"SELECT mem_no, 'resolved' AS status FROM memories WHERE {has('cache', 'title', 'file_path')} AND {ACTIVE}",
    "k20_vacuumed": "SELECT DISTINCT source_id, file_path AS path FROM memories WHERE source_id IS NOT NULL AND file_path IS NOT NULL AND NOT starts_with(file_path, 'backup/')",
    "k23_copied": f"SELECT mem_no, md5(t) AS digest, length(t)::BIGINT AS n_chars FROM (SELECT mem_no, concat_ws({JOINT}, '## [' || upper({B('mem_type')}) || '] ' || {B('title')}, {GIVEN('context', '**Context**: ')}, {B('content')}, {GIVEN('reasoning', '**Reasoning**: ')}, '---') AS t FROM memories)",
    "p07_display": f"SELECT mem_no, md5(t) AS digest, length(t)::BIGINT AS n_chars FROM (SELECT mem_no, concat_ws({NL}, '[' || {B('mem_type')} || '] ' || {B('title')} || ' (' || {B('mem_date')} || ')', {B('content')}, {GIVEN('reasoning', 'Why: ')}, {GIVEN('impact', 'Impact: ')}) AS t FROM memories)",
    "p05_turn_texts": f"SELECT msg_id, md5(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || {oracle.denoised('t')}) AS digest FROM (SELECT msg_id, role, {trim('text')} AS t FROM chat_messages WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND conv_id IS NOT NULL) WHERE t <> '' AND NOT (role = 'assistant' AND length(t) < 30)",
    "p09_folders": "SELECT meta_no, array_to_string(p[1:greatest(len(p) - CASE source WHEN 'cursor' THEN 2 WHEN 'codex' THEN 4 ELSE 1 END, 0)], '/') AS folder FROM (SELECT meta_no, source, string_split(file_path, '/') AS p FROM conversation_meta)",
    "a01_newest": "SELECT mem_no FROM memories ORDER BY coalesce(mem_date, '') DESC, mem_no LIMIT 10",
    "a02_types": "SELECT source_id, mem_type, count(*)::BIGINT AS n FROM memories WHERE coalesce(source_id, '') <> '' GROUP BY 1, 2",
    "a04_cards": f"SELECT m.source_id, mem_no, {ID} AS id, title, coalesce(mem_date, '') AS mem_date, coalesce(status, 'active') AS status, a.author FROM memories m JOIN (SELECT source_id, author FROM (SELECT source_id, author, row_number() OVER (PARTITION BY source_id ORDER BY mem_no) AS r FROM memories) WHERE r = 1) a ON a.source_id = m.source_id WHERE m.source_id <> ''",
    "a05_pair_counts": f"WITH {PAIRS} SELECT r.reason, count(rs.reason)::BIGINT AS n FROM (SELECT unnest(['duplicate', 'subsumed']) AS reason) r LEFT JOIN rs ON rs.reason = r.reason GROUP BY 1",
    "a05_summary": f"""WITH {QUALITY}, {PAIRS}, fl AS (SELECT DISTINCT file_path FROM (SELECT file_path FROM g WHERE v UNION ALL SELECT file_path FROM memories WHERE mem_no IN (SELECT a FROM rs WHERE reason IS NOT NULL UNION SELECT b FROM rs WHERE reason IS NOT NULL))),
        o AS (SELECT (SELECT count(*) FROM g) AS total, (SELECT count(*) FROM g WHERE v) AS vague, (SELECT count(*) FROM rs WHERE reason = 'duplicate') AS duplicates, (SELECT count(*) FROM rs WHERE reason = 'subsumed') AS subsumed, (SELECT count(*) FROM fl) AS flagged)
        SELECT metric, n::BIGINT AS n FROM (SELECT unnest(['total', 'vague', 'duplicates', 'subsumed', 'flagged', 'healthy', 'flagged_pct']) AS metric, unnest([total, vague, duplicates, subsumed, flagged, total - flagged, floor(100 * flagged / total + 0.5)::BIGINT]) AS n FROM o)""",
    "a05_vague_samples": f"WITH {QUALITY} SELECT mem_no, substring(content, 1, 180) AS content FROM g WHERE v ORDER BY mem_no LIMIT 20",
    "a11_misses": f"""WITH {FIX} SELECT e.fixture_id, e.pos, coalesce(max(CASE WHEN x.pos IS NOT NULL THEN len(list_filter(e.must, lambda w: contains(x.text, lower(w)))) END), 0)::INT AS hits, len(any_value(e.must))::INT AS needed, count(x.pos)::BIGINT AS same_type
        FROM e LEFT JOIN x ON x.fixture_id = e.fixture_id AND x.mem_type = e.mem_type GROUP BY 1, 2""",
    "a12_evidence": f"WITH {EVIDENCE} SELECT mem_no, hit::INT AS matched, (n - hit)::INT AS missed, fulls AS full, partials AS partial FROM v",
    "a13_evidence_by_type": f"WITH {EVIDENCE} SELECT mem_type, count(*)::BIGINT AS n, (count(*) FILTER (WHERE fulls))::BIGINT AS full, (count(*) FILTER (WHERE partials))::BIGINT AS partial, (count(*) FILTER (WHERE fulls)) / count(*) AS rate FROM v GROUP BY 1",
    "a14_checks": f"SELECT CASE WHEN NOT coalesce(mem_type IN ('decision', 'architecture', 'convention', 'todo', 'issue'), false) OR {B('title')} = '' OR {B('content')} = '' THEN 'fail' WHEN {B('mem_date')} = '' OR {B('author')} = '' THEN 'warn' ELSE 'ok' END AS status, count(*)::BIGINT AS n FROM memories GROUP BY 1",
    "t09_key_tokens": f"SELECT mem_no, array_to_string(list_sort({TOKENS('content')}), '|') AS tokens FROM memories",
    "t12_width": "SELECT mem_no, (length(title) + len(list_filter(string_split(title, ''), lambda c: unicode(c) > 11903)))::BIGINT AS width FROM memories WHERE title IS NOT NULL",
    "t08_sanitised": "SELECT msg_id, len(list_filter(string_split(text, ''), lambda c: NOT (unicode(c) <= 8 OR unicode(c) IN (11, 12, 127) OR unicode(c) BETWEEN 14 AND 31 OR unicode(c) > 65535)))::BIGINT AS n_chars FROM chat_messages WHERE text IS NOT NULL",
    "r09_conversations": """WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn_count, -1) DESC, meta_no) AS r FROM conversation_meta WHERE conv_id IS NOT NULL)
        SELECT conv_id, title, turn_count AS turns, CASE WHEN conv_id IN (SELECT source_id FROM memories WHERE source_id IS NOT NULL) THEN '[+]' WHEN turn_count > 0 THEN '[~]' ELSE '[ ]' END AS mark FROM b WHERE r = 1""",
    "j11_history": """WITH l AS (SELECT DISTINCT mem_no, unnest(flatten(list_transform(links.implementations, lambda x: coalesce(x.paths, [])))) AS path FROM memories), c AS (SELECT full_sha, commit_date, unnest(paths) AS path FROM commits WHERE full_sha IS NOT NULL),
        h AS (SELECT mem_no, count(DISTINCT full_sha)::BIGINT AS commits, max(commit_date) AS last_commit FROM l JOIN c USING (path) GROUP BY 1) SELECT mem_no, coalesce(commits, 0)::BIGINT AS commits, last_commit, coalesce(last_commit, mem_date) AS place FROM memories LEFT JOIN h USING (mem_no)""",
    "j13_by_node": f"SELECT mem_no FROM memories WHERE {NODE} = (SELECT min({NODE}) FROM memories)",
    "w06_index_updates": f"""WITH i AS (SELECT DISTINCT {ID} AS id FROM memories), e AS (SELECT id, bool_or(model = 'embed-base-v2' AND vector IS NOT NULL) AS sound FROM vector_entries WHERE id IS NOT NULL GROUP BY 1)
        SELECT i.id, 'add' AS action FROM i LEFT JOIN e USING (id) WHERE NOT coalesce(sound, false) UNION ALL SELECT id, 'drop' FROM e WHERE id NOT IN (SELECT id FROM i)""",
}
SQL = {k: v for k, v in SQL.items() if v}
