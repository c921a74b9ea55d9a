"""Counts, summaries and graphs of the record store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import jstext


def overview(memories: DataFrame) -> DataFrame:
    """(metric, key, n): records in all, by status, type, author and month; unknown where the date gives no month."""
    status = F.when(F.col("status") == "resolved", "resolved").otherwise("active")
    month = F.when(F.col("mem_date").rlike("^[0-9]{4}-[0-9]{2}"), F.substring("mem_date", 1, 7)).otherwise("unknown")
    keys = {"total": F.lit("all"), "status": status, "type": F.col("mem_type"), "author": F.nullif("author", F.lit("")), "month": month}
    pairs = F.array(*(F.struct(F.lit(metric).alias("metric"), key.alias("key")) for metric, key in keys.items()))
    rows = memories.select(F.explode(pairs).alias("p")).select("p.metric", "p.key").where("key is not null")
    return rows.groupBy("metric", "key").agg(F.count("*").alias("n"))


def conversations(memories: DataFrame) -> DataFrame:
    """(source_id, title, source_type, n, n_types, first_date, last_date) of every conversation that has records.

    The title is that of the record with the lowest mem_no, (untitled) where it has none. Dates
    are compared as written; empty ones do not count.
    """
    rows = memories.where(F.col("source_id").isNotNull() & (F.col("source_id") != ""))
    title = F.coalesce(F.nullif(F.min_by("source_title", "mem_no"), F.lit("")), F.lit("(untitled)"))
    day = F.nullif("mem_date", F.lit(""))
    return rows.groupBy("source_id").agg(
        title.alias("title"), F.min_by("source_type", "mem_no").alias("source_type"), F.count("*").alias("n"), F.countDistinct("mem_type").alias("n_types"), F.min(day).alias("first_date"), F.max(day).alias("last_date")
    )


def same_conversation(memories: DataFrame) -> DataFrame:
    """(mem_no, source_id, links): the conversation class of every record and how many others it has there."""
    rows = memories.where(F.col("source_id").isNotNull() & (F.col("source_id") != "")).select("mem_no", "source_id")
    sizes = rows.groupBy(F.col("source_id").alias("__s")).agg((F.count("*") - 1).alias("links"))
    return rows.join(sizes, F.col("source_id") == F.col("__s")).select("mem_no", "source_id", "links")


def keyword_edges(memories: DataFrame, least: int = 2, most: int = 8) -> DataFrame:
    """(a, b) of records of different conversations whose titles share a word that `least` to `most` titles have.

    Words have more than three characters. A word has at most `most` postings, so its pairs are few.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("title"), rf"[{jstext.WS[1:-1]}\-_/]+"), lambda w: F.length(w) > 3))
    posted = memories.where("title is not null").select("mem_no", "source_id", F.explode(words).alias("word"))
    rare = posted.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") <= most)).select("word")
    kept = posted.join(rare, "word")
    left = kept.select("word", F.col("mem_no").alias("a"), F.col("source_id").alias("sa"))
    right = kept.select("word", F.col("mem_no").alias("b"), F.col("source_id").alias("sb"))
    apart = ~(F.coalesce(F.nullif("sa", F.lit("")) == F.nullif("sb", F.lit("")), F.lit(False)))
    return left.join(right, "word").where((F.col("a") < F.col("b")) & apart).select("a", "b").distinct()


def commit_links(memories: DataFrame) -> DataFrame:
    """(short_sha, mem_no, links): the records of every commit that two or more records name, and how many others each has there."""
    named = memories.select("mem_no", F.explode("links.implementations.short_sha").alias("short_sha")).where("short_sha is not null").distinct()
    sizes = named.groupBy(F.col("short_sha").alias("__s")).agg((F.count("*") - 1).alias("links")).where("links > 0")
    return named.join(sizes, F.col("short_sha") == F.col("__s")).select("short_sha", "mem_no", "links")


def quality_report(memories: DataFrame) -> DataFrame:
    """(score, n, vague): records by number of technical details, and how many of them are vague."""
    rows = memories.select(jstext.specificity(F.col("content")).alias("score"), jstext.is_vague(F.col("content"), F.col("impact")).alias("v"))
    return rows.groupBy("score").agg(F.count("*").alias("n"), F.count_if("v").alias("vague"))


def budget_prefix(memories: DataFrame, budget: int = 60_000) -> DataFrame:
    """(mem_no, size, total): the newest records whose texts together fit the budget, at least one.

    Every text has one character or more, so no more than `budget` rows can fit: the newest
    `budget` rows are taken first and only they are summed up.
    """
    size = F.length(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    newest = memories.where("title is not null and mem_date is not null").select("mem_no", "mem_date", size.alias("size")).orderBy(F.desc("mem_date"), "mem_no").limit(budget)
    run = Window.orderBy(F.desc("mem_date"), "mem_no").rowsBetween(Window.unboundedPreceding, 0)
    summed = newest.withColumn("total", F.sum("size").over(run)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("mem_date"), "mem_no")))
    return summed.where((F.col("total") <= budget) | (F.col("place") == 1)).select("mem_no", "size", "total")


def stratified(df: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """(stratum, key): the n lowest keys of every stratum."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(key))
    return df.where(F.col(stratum).isNotNull()).select(stratum, key).withColumn("__p", place).where(F.col("__p") <= n).drop("__p")
