"""Markdown records, record bundles and commit logs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.jstext import trim

#: The labels of a record's fields.
LABELS = {
    "mem_date": ("日期", "Date"), "author": ("作者", "Author"), "status": ("状态", "Status"), "source": ("来源", "Source"), "source_title": ("对话", "Conversation"),
    "context": ("上下文", "Context"), "content": ("内容", "Content"), "reasoning": ("理由", "Reasoning"), "alternatives": ("排除方案", "Alternatives"), "impact": ("影响", "Impact"),
}
ANY = "|".join(x for pair in LABELS.values() for x in pair)


def markdown(files: DataFrame) -> DataFrame:
    """Records of (path, raw) Markdown texts; the type's folder and the author come from the path where the text has none.

    A field reaches to the next label after an empty line or the end. Missing optional fields are
    null, missing others ''.
    """
    text = F.regexp_replace("raw", "\r\n?", "\n")
    rows = files.select("path", text.alias("t"))
    name = lambda f: "|".join(LABELS[f])
    head = lambda f, p: F.regexp_extract("t", rf"(?m)>\s*\*\*(?:{name(f)})\*\*[:：]\s*{p}", 1)
    body = lambda f: trim(F.regexp_extract("t", rf"(?s)\*\*(?:{name(f)})\*\*[:：]\s*(.+?)(?=\n\n\*\*(?:{ANY})\*\*[:：]|\n*<!--links|\s*\z)", 1))
    none = lambda c: F.nullif(c, F.lit(""))
    title = F.regexp_extract("t", r"(?m)^# (.+)$", 1)
    file_name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    links = F.from_json(F.regexp_extract("t", r"(?s)<!--links\n(.*?)\n-->", 1), "implementations array<struct<sha string, short_sha string, paths array<string>, method string, score double, confirmed_by string>>")
    return rows.select(
        "path", F.element_at(F.split("path", "/"), -2).alias("folder"), F.coalesce(none(trim(title)), file_name).alias("title"), head("mem_date", r"(\d{4}-\d{2}-\d{2})").alias("mem_date"), none(trim(head("author", "(.+?)[ \\t]*$"))).alias("author"),
        F.when(head("status", r"(\w+)") == "resolved", "resolved").otherwise("active").alias("status"), head("source", r"(\w[\w-]*):\w+").alias("source_type"), head("source", r"\w[\w-]*:(\w+)").alias("source_id"), trim(head("source_title", "(.+)$")).alias("source_title"),
        body("context").alias("context"), body("content").alias("content"), none(body("reasoning")).alias("reasoning"), none(body("alternatives")).alias("alternatives"), none(body("impact")).alias("impact"), links.alias("links"),
    )


def rendered(memories: DataFrame, zh: bool = False) -> DataFrame:
    """(mem_no, raw): the Markdown of every record."""
    label = lambda f: LABELS[f][0 if zh else 1]
    field = lambda f: F.when(F.coalesce(F.col(f), F.lit("")) != "", F.concat(F.lit(f"**{label(f)}**: "), F.col(f), F.lit("\n\n"))).otherwise("")
    author = F.when(F.coalesce("author", F.lit("")) != "", F.concat(F.lit(f"> **{label('author')}**: "), "author", F.lit("  \n"))).otherwise("")
    status = F.when(F.col("status") == "resolved", F.lit(f"> **{label('status')}**: resolved  \n")).otherwise("")
    head = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit(f"\n\n> **{label('mem_date')}**: "), F.coalesce("mem_date", F.lit("")), F.lit("  \n"), author, status)
    source = F.concat(F.lit(f"> **{label('source')}**: "), F.coalesce("source_type", F.lit("")), F.lit(":"), F.substring(F.coalesce("source_id", F.lit("")), 1, 8), F.lit(f"  \n> **{label('source_title')}**: "), F.coalesce("source_title", F.lit("")), F.lit("\n\n---\n\n"))
    content = F.concat(F.lit(f"**{label('content')}**: "), F.coalesce("content", F.lit("")), F.lit("\n\n"))
    return memories.select("mem_no", F.concat(head, source, field("context"), content, field("reasoning"), field("alternatives"), field("impact")).alias("raw"))


def commit_log(lines: DataFrame) -> DataFrame:
    """Commits of (log, line_no, line) rows of a bulk log.

    A commit starts with BCOMMIT and five tab-separated parts, its body stands between BODY_START
    and BODY_END, and the other lines that are not blank are its paths. Lines belong to the last
    header before them in their log.
    """
    order = Window.partitionBy("log").orderBy("line_no")
    header, inside = F.col("line").startswith("BCOMMIT\t"), F.sum(F.when(F.col("line") == "BODY_START", 1).when(F.col("line") == "BODY_END", -1).otherwise(0)).over(order)
    rows = lines.withColumn("commit", F.sum(F.when(header, 1).otherwise(0)).over(order)).withColumn("in_body", inside > 0).where("commit > 0")
    part = F.split("line", "\t", 6)
    kind = F.when(header, "head").when(F.col("line").isin("BODY_START", "BODY_END"), "mark").when(F.col("in_body"), "body").when(trim(F.col("line")) != "", "path")
    rows = rows.withColumn("kind", kind).where("kind is not null")
    text = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    paths = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "path", F.struct("line_no", "line")))), lambda x: trim(x["line"]))
    grouped = rows.groupBy("log", "commit").agg(F.max(F.when(F.col("kind") == "head", F.col("line"))).alias("line"), text("body").alias("body"), paths.alias("paths"))
    parts = grouped.where(F.size(part) == 6)
    return parts.select("log", part[1].alias("full_sha"), part[2].alias("sha"), part[3].alias("commit_date"), part[4].alias("author"), part[5].alias("subject"), trim(F.col("body")).alias("body"), "paths")
