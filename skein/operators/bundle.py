"""Bundles of records: checked, read, written and taken over into a store."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import store
from skein.operators.extraction import TYPES

#: The version of a bundle and the sources a record may come from.
VERSION = 1
SOURCES = ("cursor", "claude-code", "windsurf", "copilot", "codex")
FIELDS = ("mem_type", "title", "mem_date", "context", "content", "reasoning", "alternatives", "impact", "source_id", "source_title", "source_type", "author", "status")


def first_error() -> Column:
    """The first rule that a bundle's record breaks, null where it is sound."""
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = [
        (~F.coalesce(F.col("mem_type").isin(*TYPES), F.lit(False)), "type"), (missing("title"), "title"), (missing("content"), "content"),
        (~F.coalesce(F.col("mem_date").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.lit(False)), "date"), (missing("source_id"), "sourceId"),
        (~F.coalesce(F.col("source_type").isin(*SOURCES), F.lit(False)), "sourceType"),
    ]
    return reduce(lambda made, rule: made.when(*rule), rules[1:], F.when(*rules[0]))


def entries(memories: DataFrame, types: tuple[str, ...] = (), resolved: bool = False, source_id: str | None = None) -> DataFrame:
    """The records that a bundle takes: of the given types or all, open ones unless resolved, of one conversation or all.

    Empty contexts and source titles are null, the status is active or resolved.
    """
    kept = memories if resolved else memories.where(F.coalesce("status", F.lit("active")) != "resolved")
    kept = kept.where(F.col("mem_type").isin(*types)) if types else kept
    kept = kept if source_id is None else kept.where(F.startswith("source_id", F.lit(source_id)))
    status = F.when(F.col("status") == "resolved", "resolved").otherwise("active")
    blank = lambda c: F.nullif(c, F.lit("")).alias(c)
    other = [c for c in FIELDS if c not in ("context", "source_title", "status")]
    return kept.select("mem_no", *other, blank("context"), blank("source_title"), status.alias("status"))


def records(entries_: DataFrame) -> DataFrame:
    """A bundle's entries as records again: missing contexts and source titles are ''."""
    return entries_.select(*(F.coalesce(c, F.lit("")).alias(c) if c in ("context", "source_title") else F.col(c) for c in entries_.columns))


def write(entries_: DataFrame, path: str, exported_at: str, producer: str = "skein", scope: str | None = None) -> int:
    """Writes a bundle: entries as JSON lines under path/memories, and its head as one line under path/head. Returns the number of entries."""
    spark = entries_.sparkSession
    entries_.write.mode("overwrite").json(f"{path}/memories")
    n = spark.read.schema(entries_.schema).json(f"{path}/memories").count()
    head = spark.createDataFrame([(VERSION, exported_at, n, producer, scope)], "version int, exportedAt string, memoryCount bigint, producer string, scope string")
    head.coalesce(1).write.mode("overwrite").json(f"{path}/head")
    return n


class BundleError(ValueError):
    """A bundle that cannot be read."""


def head_of(text: str) -> dict:
    """The head of a bundle given as one JSON object, checked; memoryCount defaults to the number of its records."""
    try:
        value = json.loads(text)
    except ValueError as error:
        raise BundleError(f"no JSON: {error}") from None
    if not isinstance(value, dict):
        raise BundleError("a bundle is an object")
    version = value.get("version")
    if isinstance(version, bool) or not isinstance(version, (int, float)):
        raise BundleError("version is missing")
    if version != VERSION:
        raise BundleError(f"version {version} is not {VERSION}")
    if not isinstance(value.get("memories"), list):
        raise BundleError("memories is missing")
    text_or = lambda name, other: value[name] if isinstance(value.get(name), str) else other
    count = value.get("memoryCount")
    return {"version": VERSION, "exportedAt": text_or("exportedAt", ""), "memoryCount": count if isinstance(count, (int, float)) and not isinstance(count, bool) else len(value["memories"]), "producer": text_or("producer", "unknown"), "exportedBy": text_or("exportedBy", None), "scope": text_or("scope", None)}


#: The names of the fields in a bundle file.
NAMES = {"mem_type": "type", "mem_date": "date", "source_id": "sourceId", "source_title": "sourceTitle", "source_type": "sourceType"}


def read_file(spark: SparkSession, text: str) -> DataFrame:
    """(pos, FIELDS) of a bundle given as one JSON object; a BundleError names the first record that breaks a rule."""
    head_of(text)
    rows = spark.createDataFrame([(text,)], "raw string").select(F.posexplode(F.try_variant_get(F.parse_json("raw"), "$.memories", "array<variant>")).alias("pos", "e"))
    field = lambda c: F.when(F.schema_of_variant(F.try_variant_get("e", f"$.{NAMES.get(c, c)}", "variant")) == "STRING", F.try_variant_get("e", f"$.{NAMES.get(c, c)}", "string")).alias(c)
    found = rows.select("pos", *(field(c) for c in FIELDS)).withColumn("status", F.when(F.col("status") == "resolved", "resolved").otherwise("active"))
    bad = found.where(first_error().isNotNull()).select("pos", first_error().alias("error")).orderBy("pos").first()
    if bad:
        raise BundleError(f"memories[{bad.pos}].{bad.error}")
    return found


def take_over(bundle: DataFrame, stored: DataFrame, author: str | None = None, overwrite: bool = False) -> DataFrame:
    """(author, action, n): how many of a bundle's records an import creates, updates or skips, by author.

    author replaces the records' own before the comparison; records without any go to unknown.
    """
    own = bundle.withColumn("author", F.lit(author)) if author is not None else bundle
    plan = store.import_plan(own, stored)
    action = F.when(F.col("import_action") == "import", "create").when(F.lit(overwrite), "update").otherwise("skip")
    return plan.select(F.coalesce(F.nullif("author", F.lit("")), F.lit("unknown")).alias("author"), action.alias("action")).groupBy("author", "action").agg(F.count("*").alias("n"))
