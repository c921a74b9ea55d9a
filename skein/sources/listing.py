"""Listings of conversations and files, before any of them is read as turns."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.jstext import WS, trim
from skein.operators import nested

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def short_title(text: Column) -> Column:
    """A text on one line, cut to 57 characters and ... where it is longer than 60."""
    flat = trim(F.regexp_replace(text, f"{WS}+", " "))
    return F.when(F.length(flat) > 60, F.concat(F.substring(flat, 1, 57), F.lit("..."))).otherwise(flat)


def titled(turns: DataFrame, key: str, order: list[str], prefix: int = 8) -> DataFrame:
    """(key, title): the first user text that is not blank, in order, as a title; else the first characters of the key."""
    shown = F.when((F.col("role") == "user") & (trim(F.coalesce("text", F.lit(""))) != ""), F.struct(*order, "text"))
    first = turns.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(shown).alias("f"))
    return first.select(key, F.coalesce(short_title(F.col("f.text")), F.substring(key, 1, prefix)).alias("title"))


def line_counts(lines: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, turns): lines of every file that mention a role, which is how many turns a listing shows."""
    return lines.groupBy(key).agg(F.count_if(F.contains(raw, F.lit('"role"'))).alias("turns"))


def labelled_counts(files: DataFrame) -> DataFrame:
    """(path, turns) of (path, raw) label files: 2 where any label occurs, else 0."""
    return files.select("path", F.when(F.col("raw").rlike(r"(?m)^(?:user|assistant):[ \t\r]*$"), 2).otherwise(0).alias("turns"))


def with_titles(listing: DataFrame, titles: DataFrame) -> DataFrame:
    """listing (conv_id, title) with the titles of a table (conv_id, title) instead of its own where that has one."""
    own = titles.where("title is not null and title <> ''").groupBy(F.col("conv_id").alias("__c")).agg(F.min("title").alias("__t"))
    joined = listing.join(own, F.col("conv_id") == F.col("__c"), "left")
    return joined.select(*(F.coalesce("__t", "title").alias("title") if c == "title" else F.col(c) for c in listing.columns))


def key_titles(items: DataFrame, key: str = "composer.composerData") -> DataFrame:
    """(conv_id, title) of the rows (key, value) of an editor's item table: value lists allComposers with composerId and name."""
    listed = items.where(F.col("key") == key).select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$.allComposers", "array<variant>")).alias("v"))
    return listed.select(F.try_variant_get("v", "$.composerId", "string").alias("conv_id"), F.try_variant_get("v", "$.name", "string").alias("title")).where("conv_id is not null")


def item_table(spark: SparkSession, database: str, url: str | None = None) -> DataFrame:
    """(key, value) of an editor's item table over JDBC; the filters on key reach the database."""
    return spark.read.format("jdbc").option("url", url or f"jdbc:sqlite:{database}").option("dbtable", "ItemTable").load().select("key", F.col("value").cast("string").alias("value"))


#: The keys under which a chat database keeps its chats.
CHAT_KEYS = ("%chat%", "%cascade%", "%conversation%", "%session%")


def chat_rows(items: DataFrame) -> DataFrame:
    """(path, raw) of the item rows whose key may hold chats; path is ws:key."""
    likely = F.lit(False)
    for k in CHAT_KEYS:
        likely = likely | F.lower("key").like(k)
    return items.where(likely & F.col("value").isNotNull()).select(F.concat(F.lit("ws:"), "key").alias("path"), F.col("value").alias("raw"))


def chosen_project(projects: DataFrame, cwd: str) -> DataFrame:
    """The one row of projects (name, conversations, modified_ms) for a working folder.

    Numeric and temporary names and empty projects are left out. A name that the folder, with -
    for its separators, ends with wins; else most conversations, then the newest, then the name.
    """
    name = F.lower("name")
    real = ~(F.col("name").rlike(r"^\d+$") | F.contains(name, F.lit("appdata")) | F.contains(name, F.lit("temp")))
    here = re.sub(r"[/\\]", "-", cwd).replace(":", "").lower()
    match = F.endswith(F.lit(here), name)
    return projects.where(real & (F.col("conversations") > 0)).orderBy(F.desc(match), F.desc("conversations"), F.desc("modified_ms"), "name").limit(1)


def of_folder(files: DataFrame, cwd: str, folder: str = "folder") -> DataFrame:
    """files of the folders whose encoded name ends with a working folder's or contains its last part; all of them where none does."""
    encoded, last = re.sub(r"[/\\:]", "-", cwd).lower(), re.split(r"[/\\]", cwd.rstrip("/\\"))[-1].lower()
    name = F.lower(F.col(folder))
    hits = files.where(F.endswith(name, F.lit(encoded)) | F.contains(name, F.lit("-" + last)))
    return files if hits.isEmpty() else hits


def transcripts_by_uuid(files: DataFrame, path: str = "path") -> DataFrame:
    """files whose name is a UUID and .jsonl."""
    return files.where(F.col(path).rlike(rf"(?:^|/){UUID}\.jsonl$"))


def rollout_id(path: Column) -> Column:
    """A rollout's id: its file name without .jsonl; a title falls back to its first 24 characters."""
    return F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"\.jsonl$", "")


def rollout_titles(turns: DataFrame) -> DataFrame:
    """(path, title) of rollout turns (path, turn, role, text): the first user text among the first ten lines, else the start of the id."""
    early = turns.groupBy("path").agg(F.min(F.when((F.col("role") == "user") & (F.col("turn") < 10), F.struct("turn", "text"))).alias("f"))
    return early.select("path", F.coalesce(short_title(F.col("f.text")), F.substring(rollout_id(F.col("path")), 1, 24)).alias("title"))


def store_files(paths: DataFrame, path: str = "file_path") -> DataFrame:
    """paths with folder_author and folder_type: what a record's place in the store says of it.

    author/type/file.md, or type/file.md in the older layout, without author. Other places,
    folders that start with a dot and files that are no .md give null for both.
    """
    types = {"decisions": "decision", "architecture": "architecture", "conventions": "convention", "todos": "todo", "issues": "issue"}
    types |= {v: v for v in types.values()}
    parts = F.split(F.col(path), "/")
    kind = F.coalesce(*(F.when(F.get(F.reverse(parts), F.lit(1)) == k, v) for k, v in types.items()))
    sound = F.endswith(F.col(path), F.lit(".md")) & ~F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    author = F.when(sound & kind.isNotNull(), F.get(F.reverse(parts), F.lit(2)))
    return paths.withColumn("folder_type", F.when(sound, kind)).withColumn("folder_author", author)


# --- sessions with nested requests --------------------------------------------------------------


def _answer(part: Column) -> Column:
    """The text of a reply part of kind markdownContent, null for others."""
    return F.when(F.element_at(part, "kind") == "markdownContent", F.coalesce(F.element_at(part, "value.value"), F.element_at(part, "value")))


def session_turns(files: DataFrame) -> DataFrame:
    """(file_id, request_ord, role, text) of every request of a file's session: the question, and the answer where there is one.

    Requests without text and slash commands are left out with their answers. A list of replies
    answers by its markdownContent parts, joined by line ends; a single object by its value or
    result.value. Requests are split into rows before their texts are joined, so a session is
    gathered by request only.
    """
    rows = nested.shred(files, "file_id", "raw")
    leaf = lambda n: F.element_at("leaves", n)
    at = F.col("ordinals")[0]
    asked = rows.where("node = 'request'").select("key", at.alias("request_ord"), trim(F.coalesce(leaf("message.text"), leaf("message"))).alias("text")).where("text <> '' and not startswith(text, '/')")
    replies = rows.where("node = 'reply'").select("key", at.alias("request_ord"), F.col("ordinals")[1].alias("n"), F.coalesce(_answer(F.col("leaves")), F.when(F.element_at("leaves", "kind").isNull(), F.coalesce(leaf("value"), leaf("result.value")))).alias("t"))
    joined = replies.where("t is not null").groupBy("key", "request_ord").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("parts"))
    answers = joined.select("key", "request_ord", trim(F.array_join(F.transform("parts", lambda p: p["t"]), "\n")).alias("text")).where("text <> ''")
    answered = answers.join(asked.select("key", "request_ord"), ["key", "request_ord"], "left_semi")
    both = asked.withColumn("role", F.lit("user")).unionByName(answered.withColumn("role", F.lit("assistant")))
    return both.select(F.col("key").alias("file_id"), "request_ord", "role", "text")


def session_listing(files: DataFrame) -> DataFrame:
    """(file_id, turns, title): twice the number of requests, and the first question among the first three that is no slash command, else the start of the session's id."""
    rows = nested.shred(files, "file_id", "raw")
    leaf = lambda n: F.element_at("leaves", n)
    text = trim(F.coalesce(leaf("message.text"), leaf("message")))
    place = F.when(F.col("node") == "request", F.col("ordinals")[0])
    usable = (place < 3) & (text != "") & ~F.startswith(text, F.lit("/"))
    found = rows.where("node in ('session', 'request')").groupBy("key").agg(
        F.max(place).alias("last"), F.min(F.when(usable, F.struct(place.alias("p"), text.alias("t")))).alias("first"), F.max(F.when(F.col("node") == "session", leaf("sessionId"))).alias("sid")
    )
    return found.select(F.col("key").alias("file_id"), (2 * (F.coalesce("last", F.lit(-1)) + 1)).alias("turns"), F.coalesce(short_title(F.col("first.t")), F.substring("sid", 1, 8)).alias("title"))


# --- all sources --------------------------------------------------------------------------------

Reader = Callable[[SparkSession, str], DataFrame]


def detected(readers: dict[str, tuple[str, Reader]], exists: Callable[[str], bool]) -> list[str]:
    """The names of the sources (folder, reader) whose folder exists, in the order of the registry."""
    return [name for name, (folder, _) in readers.items() if exists(folder)]


def all_turns(spark: SparkSession, readers: dict[str, tuple[str, Reader]], names: list[str], config: dict | None = None) -> DataFrame | None:
    """The turns of the named sources as one table with a column source; sources that the configuration switches off are left out. None for none."""
    from skein.operators.extraction import enabled

    parts = [readers[n][1](spark, readers[n][0]).withColumn("source", F.lit(n)) for n in names if enabled(config or {}, n)]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def lookup(listing: DataFrame, conv_id: str) -> DataFrame:
    """The rows of one conversation, by its whole id."""
    return listing.where(F.col("conv_id") == conv_id)


def display_folder(path: Column, source: Column) -> Column:
    """The folder a listing shows for a source: the path without its last part, without two for cursor, four for codex."""
    parts = F.split(path, "/")
    cut = F.when(source == "cursor", 2).when(source == "codex", 4).otherwise(1)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - cut, F.lit(0))), "/")


# --- logs of one file ---------------------------------------------------------------------------

#: Status letters of a log.
CHANGES = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied"}


def log_records(spark: SparkSession, path: str, mark: str = "COMMIT") -> DataFrame:
    """(record) of a log file, one row per commit: the file is split at its headers, in parallel, so that no log is one task."""
    rows = spark.read.text(path, lineSep=f"\n{mark}\t")
    return rows.select(F.regexp_replace("value", rf"\A{mark}\t", "").alias("record")).where("trim(record) <> ''")


def file_log(records: DataFrame) -> DataFrame:
    """(sha, commit_date, author, subject, change_kind, from_path) of log records of one file.

    A record is sha, date, author and subject separated by tabs, then status lines, the first of
    which counts. Subjects keep their tabs; records with fewer parts give no rows.
    """
    line = F.split("record", "\n")
    head = F.split(line[0], "\t", 4)
    status = F.get(F.filter(F.slice(line, 2, 1_000_000), lambda x: x.rlike(r"^(?:[AMD]|[RC]\d*)(?:\t|$)")), F.lit(0))
    part = F.filter(F.split(status, "\t"), lambda x: x != "")
    kind = F.create_map(*(F.lit(x) for pair in CHANGES.items() for x in pair))
    rows = records.where(F.size(head) == 4)
    moved = F.substring(status, 1, 1).isin("R", "C") & (F.size(part) >= 3)
    return rows.select(head[0].alias("sha"), head[1].alias("commit_date"), head[2].alias("author"), head[3].alias("subject"), F.coalesce(kind[F.substring(status, 1, 1)], F.lit("other")).alias("change_kind"), F.when(moved, part[1]).alias("from_path"))


def git(folder: str, *arguments: str) -> str | None:
    """What git says, None where it fails; called on the driver, for one working tree."""
    try:
        done = subprocess.run(["git", "-C", folder, *arguments], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout if done.returncode == 0 else None


def in_work_tree(folder: str) -> bool:
    """Whether a folder is inside a git work tree."""
    return (git(folder, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def tracked(folder: str, path: str) -> bool:
    """Whether git tracks a path of a folder."""
    return git(folder, "ls-files", "--error-unmatch", path) is not None
