"""Records chosen for a context: by recall, conversation, age and topic, and how they are shown."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _has(columns: tuple[str, ...], words: str):
    """Whether one of the columns contains the words, in any case; false where all are null."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c)), F.lit(words.lower())), F.lit(False)) for c in columns))


def recall(memories: DataFrame, words: str, types: tuple[str, ...] = (), resolved: bool = False) -> DataFrame:
    """Records whose title, content, reasoning or alternatives contain the words; of the given types, or of all."""
    kept = memories if resolved else memories.where(F.coalesce("status", F.lit("active")) != "resolved")
    kept = kept.where(F.col("mem_type").isin(*types)) if types else kept
    return kept.where(_has(("title", "content", "reasoning", "alternatives"), words))


def in_conversation(memories: DataFrame, title: str, every: bool = False) -> DataFrame:
    """Records of the conversations whose title contains the words; of several the one with the latest record, ties by lowest mem_no, unless every."""
    hits = memories.where(F.coalesce("source_id", F.lit("")) != "").where(_has(("source_title",), title))
    found = hits.groupBy(F.col("source_id").alias("__s")).agg(F.max(F.coalesce("mem_date", F.lit(""))).alias("__d"), F.min("mem_no").alias("__m"))
    chosen = found if every else found.orderBy(F.desc("__d"), "__m").limit(1)
    return memories.join(chosen.select("__s"), F.col("source_id") == F.col("__s"), "left_semi")


def recent(memories: DataFrame, as_of: str, days: int) -> DataFrame:
    """Records whose date, compared as text, is not before `days` days before as_of."""
    return memories.where(F.col("mem_date") >= F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyy-MM-dd"))


def on_topic(memories: DataFrame, topic: str) -> DataFrame:
    """Records on a topic; all of them where none is."""
    hits = memories.where(_has(("title", "content", "context", "impact"), topic))
    return memories if hits.isEmpty() else hits


def snippet(text, words: str, longest: int = 120):
    """The start of a text, cut to `longest` with ..., the words marked by **."""
    short = F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest - 3), F.lit("..."))).otherwise(text)
    escaped = "".join("\\" + c if not (c.isalnum() or c == " ") else c for c in words)
    return F.regexp_replace(short, f"(?i)({escaped})", "**$1**")


def entries(memories: DataFrame) -> DataFrame:
    """Records as a bundle lists them: empty contexts and source titles are null, the status is active or resolved."""
    status = F.when(F.col("status") == "resolved", "resolved").otherwise("active")
    blank = lambda c: F.nullif(c, F.lit("")).alias(c)
    return memories.select("mem_no", "mem_type", "title", "mem_date", blank("context"), "content", "source_id", blank("source_title"), "source_type", "author", status.alias("status"))


CHUNK, OVERLAP, LEAST = 20_000, 2_000, 100


def chunk(text: str | None) -> list[str]:
    """Windows of CHUNK characters, ended early before the last speaker in their second half, each starting OVERLAP before the end of the one before.

    A short text is one chunk as it is; later chunks are trimmed and those of LEAST characters or fewer dropped.
    """
    if text is None or len(text) <= CHUNK:
        return [] if text is None else [text]
    out, start = [], 0
    while start < len(text):
        window = text[start : start + CHUNK]
        end = len(window)
        if start + CHUNK < len(text):
            speaker = max(window.rfind("\n\nUser:"), window.rfind("\n\nAssistant:"))
            end = speaker if speaker > CHUNK // 2 else CHUNK
        part = window[:end].strip()
        if len(part) > LEAST:
            out.append(part)
        start += max((end if start + CHUNK < len(text) else CHUNK) - OVERLAP, 1000)
    return out


def chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk, text) of every chunk of every text; null texts have none."""

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(chunk)

    pieces = F.pandas_udf(cut, "array<string>")(F.col(text))
    return df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(pieces).alias("chunk", "text"))
