"""Benchmark fixtures: expected records, question sets and their conversations, checked on reading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.extraction import TYPES

SCHEMA = "id string, description string, conversation struct<title string, turns array<struct<role string, text string>>>, expected array<struct<type string, must_contain array<string>, must_not_contain array<string>>>"


class FixtureError(ValueError):
    """A fixture that breaks a rule."""


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, fixture) of every JSON file of a folder, one fixture a file."""
    whole = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    return whole.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", SCHEMA).alias("fixture"))


def problems(fixtures: DataFrame) -> DataFrame:
    """(path, problem): the first rule that each fixture breaks; ids that several files have are a problem of all of them."""
    f = F.col("fixture")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    turns, expected = f["conversation"]["turns"], f["expected"]
    rules = [
        (empty(f["id"]), "id"), (empty(f["description"]), "description"), (f["conversation"]["title"].isNull(), "title"), (F.coalesce(F.size(turns), F.lit(0)) <= 0, "turns"),
        (F.exists(turns, lambda t: ~F.coalesce(t["role"].isin("user", "assistant"), F.lit(False)) | t["text"].isNull()), "turn"), (expected.isNull(), "expected"),
        (F.exists(expected, lambda e: ~F.coalesce(e["type"].isin(*TYPES), F.lit(False)) | (F.coalesce(F.size(e["must_contain"]), F.lit(0)) <= 0)), "expected record"),
    ]
    first = reduce(lambda made, rule: made.when(*rule), rules[1:], F.when(*rules[0]))
    twice = fixtures.groupBy(f["id"].alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1")
    joined = fixtures.join(twice, f["id"] == F.col("__id"), "left")
    return joined.select("path", F.coalesce(first, F.when(F.col("__n").isNotNull(), "duplicate id")).alias("problem")).where("problem is not null")


def checked(fixtures: DataFrame) -> DataFrame:
    """(fixture_id, title, turns, expected) of sound fixtures; a FixtureError names the first file, by path, with a problem."""
    bad = problems(fixtures).orderBy("path").first()
    if bad:
        raise FixtureError(f"{bad.path}: {bad.problem}")
    return fixtures.select(F.col("fixture.id").alias("fixture_id"), "fixture.conversation.title", "fixture.conversation.turns", "fixture.expected")


def turns(fixtures: DataFrame) -> DataFrame:
    """(fixture_id, turn, role, text) of checked fixtures."""
    return fixtures.select("fixture_id", F.posexplode("turns").alias("turn", "t")).select("fixture_id", "turn", "t.role", "t.text")


def conversations(fixtures: DataFrame, modified_ms: int = 0) -> DataFrame:
    """(conv_id, title, source, modified_ms, turns) of checked fixtures, under made-up ids and one instant, so that runs are the same."""
    return fixtures.select(F.concat(F.lit("fixture:"), "fixture_id").alias("conv_id"), "title", F.lit("fixture").alias("source"), F.lit(modified_ms).cast("bigint").alias("modified_ms"), F.size("turns").alias("turns"))


def expectations(fixtures: DataFrame) -> DataFrame:
    """(fixture_id, pos, mem_type, must, must_not) of checked fixtures."""
    rows = fixtures.select("fixture_id", F.posexplode("expected").alias("pos", "e"))
    return rows.select("fixture_id", "pos", F.col("e.type").alias("mem_type"), F.col("e.must_contain").alias("must"), F.col("e.must_not_contain").alias("must_not"))


def of_manifest(samples: DataFrame, manifest: DataFrame) -> DataFrame:
    """The samples (id, ...) that a manifest (pos, id) names, with pos; ids without a sample are an error that names up to ten of them."""
    missing = manifest.join(samples.select("id"), "id", "left_anti").orderBy("pos").limit(10).collect()
    if missing:
        raise FixtureError("no sample for " + ", ".join(r.id for r in missing))
    return samples.join(manifest, "id")


def haystack_turns(samples: DataFrame) -> DataFrame:
    """(id, session, turn, role, text) of samples (id, sessions, dates): every session's turns, a dated one led by a marker turn of the user (turn -1)."""
    each = samples.select("id", "dates", F.posexplode("sessions").alias("session", "turns"))
    date = F.get("dates", F.col("session"))
    mark = each.where(F.coalesce(date, F.lit("")) != "").select("id", "session", F.lit(-1).alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("[Session "), (F.col("session") + 1).cast("string"), F.lit(" — "), date, F.lit("]")).alias("text"))
    rows = each.select("id", "session", F.posexplode("turns").alias("turn", "t")).select("id", "session", "turn", "t.role", F.col("t.content").alias("text"))
    return mark.unionByName(rows)
