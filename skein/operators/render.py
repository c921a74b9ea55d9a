"""Records as text for other programs: rule files, skill files, context blocks, notes and links.

What a record becomes is a column expression; documents are the ordered entries of a table, so
that only a writer that needs one file joins them, on the driver, within a stated budget.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.jstext import WS, trim

#: The order and the headings of the record types in a context.
ORDER = ("architecture", "decision", "convention", "todo", "issue")
HEADINGS = {
    "en": {"architecture": "Architecture", "decision": "Key Decisions (follow without re-discussion)", "convention": "Conventions (always follow)", "todo": "Active TODOs", "issue": "Known Issues & Fixes"},
    "zh": {"architecture": "架构设计", "decision": "技术决策（勿随意更改）", "convention": "代码约定（必须遵守）", "todo": "待办事项", "issue": "已知问题与解决方案"},
}
WORDS = {"en": {"why": "Why", "rejected": "Rejected", "affects": "Affects"}, "zh": {"why": "理由", "rejected": "排除", "affects": "影响"}}
SHORT = {"decision": "D", "architecture": "A", "convention": "C", "todo": "T", "issue": "I"}
#: Characters a context may have, and what its index of older records keeps of them.
CONTEXT_CHARS, INDEX_CHARS = 32_000, 2_000
#: Fixed value: the longest description of a skill.
DESCRIPTION = 300


def text_of(name: str) -> Column:
    """A column's text, '' for null."""
    return F.coalesce(F.col(name), F.lit(""))


def given(name: str, lead: str) -> Column:
    """lead and the column's text; null where the text is null or empty."""
    return F.when(text_of(name) != "", F.concat(F.lit(lead), F.col(name)))


def type_rank() -> Column:
    """The place of a record's type in ORDER; other types come last."""
    return F.coalesce(*(F.when(F.col("mem_type") == t, F.lit(i)) for i, t in enumerate(ORDER)), F.lit(len(ORDER)))


def context_entry(language: str = "en") -> Column:
    """What a context says of a record: a checkbox for todos, one line for conventions, else a dated entry with its reasons."""
    w = WORDS[language]
    title, content = text_of("title"), text_of("content")
    todo = F.concat(F.lit("- [ ] **"), title, F.lit("**"), F.when(content != title, F.concat(F.lit(" — "), content)).otherwise(""))
    convention = F.concat(F.lit("- **"), title, F.lit("**: "), content)
    other = F.concat_ws("\n  ", F.concat(F.lit("- **"), title, F.lit("** _("), text_of("mem_date"), F.lit(")_")), content, given("reasoning", f"{w['why']}: "), given("alternatives", f"{w['rejected']}: "), given("impact", f"{w['affects']}: "))
    return F.when(F.col("mem_type") == "todo", todo).when(F.col("mem_type") == "convention", convention).otherwise(other)


def index_line() -> Column:
    """A record in the index of older records."""
    mark = F.coalesce(*(F.when(F.col("mem_type") == t, s) for t, s in SHORT.items()), F.lit("?"))
    return F.concat(F.lit("- ["), mark, F.lit("] "), text_of("title"), F.lit(" _("), text_of("mem_date"), F.lit(")_"))


def context_rows(memories: DataFrame, language: str = "en") -> DataFrame:
    """(rank, mem_date, mem_no, entry) of the records of known types; a context is the entries by rank, newest date, mem_no."""
    return memories.where(F.col("mem_type").isin(*ORDER)).select(type_rank().alias("rank"), text_of("mem_date").alias("mem_date"), "mem_no", context_entry(language).alias("entry"))


def context_text(entries: list, language: str = "en", topic: str | None = None) -> str:
    """The context of (rank, entry) rows that are in order."""
    note = {"en": "Filtered by topic", "zh": "话题过滤"}[language]
    head = {"en": "## Project Context\n\n> Background from earlier conversations; paste it at the start of a new one.", "zh": "## 项目上下文\n\n> 来自以往对话的背景，可粘贴到新对话的开头。"}[language]
    parts, last = [head + (f"\n\n> {note}: {topic}" if topic else "")], None
    for rank, entry in entries:
        if rank != last:
            parts.append("### " + HEADINGS[language][ORDER[rank]])
            last = rank
        parts.append(entry)
    if len(parts) == 1:
        parts.append({"en": "_No records yet._", "zh": "_暂无记录。_"}[language])
    return "\n\n".join(parts)


def tiered(memories: DataFrame, language: str = "en", chars: int = CONTEXT_CHARS, index_chars: int = INDEX_CHARS) -> DataFrame:
    """(tier, mem_no, mem_date, text): full entries of the newest records, index lines of the older ones.

    All records are full if their context fits `chars`. Else the newest ones are, as long as
    their entries with headings and joints fit chars - index_chars, at least one. No more than
    `chars` entries can fit, each having a character at least, so only so many are summed up.
    """
    from pyspark.sql import Window

    rows = context_rows(memories, language)
    room = len(context_text([], language))
    heads = sum(len("### " + h) + 2 for h in HEADINGS[language].values())
    size = F.length("entry") + 2
    if (rows.agg(F.sum(size).alias("n")).first().n or 0) + room + heads <= chars:
        return rows.select(F.lit("full").alias("tier"), "mem_no", "mem_date", F.col("entry").alias("text"))
    newest = rows.orderBy(F.desc("mem_date"), "mem_no").limit(chars)
    order = Window.orderBy(F.desc("mem_date"), "mem_no")
    summed = newest.withColumn("total", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))
    full = summed.where((F.col("total") + room + heads <= chars - index_chars) | (F.col("place") == 1)).select(F.lit("full").alias("tier"), "mem_no", "mem_date", F.col("entry").alias("text"))
    lines = memories.select("mem_no", text_of("mem_date").alias("mem_date"), index_line().alias("text"))
    older = lines.join(full.select(F.col("mem_no").alias("__n")), F.col("mem_no") == F.col("__n"), "left_anti")
    return full.unionByName(older.select(F.lit("index").alias("tier"), "mem_no", "mem_date", "text"))


def rule_subset(memories: DataFrame) -> DataFrame:
    """The records that rule files are made of: conventions and decisions that are not resolved."""
    return memories.where(F.col("mem_type").isin("convention", "decision") & (F.coalesce("status", F.lit("active")) != "resolved"))


def rule_entry(why: str = "Why", rejected: str = "Rejected alternatives", clean: bool = False) -> Column:
    """A record as a section: heading, content and reasons; with clean, line ends are \\n and outer blanks are cut."""
    body = (lambda c: trim(F.regexp_replace(c, "\r\n", "\n"))) if clean else (lambda c: c)
    part = lambda name, lead: F.when(text_of(name) != "", F.concat(F.lit(lead + ": "), body(F.col(name))))
    title = trim(text_of("title")) if clean else text_of("title")
    return F.concat_ws("\n\n", F.concat(F.lit("## "), title), body(text_of("content")), part("reasoning", why), part("alternatives", rejected))


RULES_HEAD = '---\ndescription: "Conventions and decisions from earlier conversations"\nalwaysApply: true\n---\n\n# Project Conventions & Decisions\n\n> Follow these without re-discussion.\n'


def sections(memories: DataFrame, clean: bool = False) -> DataFrame:
    """(section, mem_no, entry) of a rule file: conventions first, then decisions, each by mem_no."""
    section = F.when(F.col("mem_type") == "convention", 0).otherwise(1)
    rejected = "Rejected" if clean else "Rejected alternatives"
    return rule_subset(memories).select(section.alias("section"), "mem_no", rule_entry(rejected=rejected, clean=clean).alias("entry"))


def rules_file(rows: list) -> str:
    """The rule file of ordered (section, entry) rows."""
    out, last = [RULES_HEAD], None
    for section, entry in rows:
        if section != last:
            out.append(("## Code Conventions", "## Technical Decisions")[section] + "\n")
            last = section
        out.append(entry + "\n")
    return "\n".join(out)


START, END = "<!-- skein:managed start -->", "<!-- skein:managed end -->"


def managed_section(rows: list) -> str:
    """The section that is kept inside a file others write too; equal records give equal bytes."""
    out, last = [START, "<!-- Generated; edit the records, not this section. -->", ""], None
    for section, entry in rows:
        if section != last:
            out += [("## Project conventions", "## Technical decisions")[section], ""]
            last = section
        out += [entry, ""]
    if last is None:
        out += ["<!-- No conventions or decisions yet. -->", ""]
    return "\n".join([*out, END])


@dataclass(frozen=True)
class Merge:
    """What a merge did: created, appended, updated, already-up-to-date or conflict, and the text to write."""

    action: str
    text: str | None = None
    reason: str | None = None


def merge_section(existing: str | None, section: str) -> Merge:
    """Puts a managed section into a file: a new file, at its end, or in place of the section between the markers.

    Markers count only at the start of a line of their own. Anything but one start before one
    end is a conflict, and the file stays as it is.
    """
    if existing is None:
        return Merge("created", f"# Agent notes\n\n{section}\n")
    at = lambda mark: list(re.finditer(rf"^{re.escape(mark)}[ \t]*$", existing, re.MULTILINE))
    starts, ends = at(START), at(END)
    if not starts and not ends:
        return Merge("appended", re.sub(r"\s+$", "", existing) + f"\n\n{section}\n")
    if len(starts) != 1 or len(ends) != 1:
        return Merge("conflict", reason=f"{len(starts)} start and {len(ends)} end markers")
    if starts[0].start() > ends[0].start():
        return Merge("conflict", reason="the end marker comes first")
    before, now, after = existing[: starts[0].start()], existing[starts[0].start() : ends[0].end()], existing[ends[0].end() :]
    return Merge("already-up-to-date") if now == section else Merge("updated", before + section + after)


#: The skills that are written: name -> (lead of the description, heading, types, whether resolved records are left out).
SKILLS = {
    "project-conventions": ("Conventions of this project. Use when writing or changing code.", "Conventions", ("convention",), False),
    "project-decisions": ("Decisions of this project. Use before proposing another way.", "Decisions", ("decision",), True),
    "project-architecture": ("Structure of this project. Use when placing new parts.", "Architecture", ("architecture",), False),
}


def skill_rows(memories: DataFrame) -> DataFrame:
    """(skill, mem_no, title, entry) of the records of every skill."""
    parts = []
    for name, (_, _, types, open_only) in SKILLS.items():
        kept = memories.where(F.col("mem_type").isin(*types))
        kept = kept.where(F.coalesce("status", F.lit("active")) != "resolved") if open_only else kept
        parts.append(kept.select(F.lit(name).alias("skill"), "mem_no", trim(text_of("title")).alias("title"), rule_entry(rejected="Rejected", clean=True).alias("entry")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def description(lead: str, titles: list[str]) -> str:
    """lead and as many titles as fit DESCRIPTION characters; an ellipsis for the others, and for the rest of a first title that does not fit."""
    titles = [t for t in titles if t]
    if not titles:
        return lead[:DESCRIPTION]
    head, taken = f"{lead} Topics: ", []
    for t in titles:
        if len(head + ", ".join([*taken, t]) + ".") > DESCRIPTION:
            room = DESCRIPTION - len(head) - 2
            if taken:
                taken.append("…")
            elif room > 0:
                taken.append(t[:room].rstrip() + "…")
            break
        taken.append(t)
    return head + ", ".join(taken) + "."


def yaml_scalar(value: str) -> str:
    """A text as a YAML scalar on one line, quoted only where it could be read as something else."""
    risky = re.search(r":\s|\s#|^[!&*\[\]{}|>?%@`#]|^[-?:]\s|^\s|\s$|[\"\\]", value)
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"' if risky else value


def skill_file(name: str, rows: list) -> str:
    """The file of a skill from its ordered (title, entry) rows."""
    lead, heading, _, _ = SKILLS[name]
    head = f"---\nname: {name}\ndescription: {yaml_scalar(description(lead, [t for t, _ in rows]))}\n---\n\n# {heading}\n\n> Generated from earlier conversations; written anew every time.\n"
    return "\n".join([head, *(e + "\n" for _, e in rows)])


def notes(memories: DataFrame) -> DataFrame:
    """(mem_no, path, raw): every record as a note with front matter, under its type's folder."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(text_of("title"), r'[<>:"/\\|?*]', ""), f"{WS}+", "-"), 1, 80)
    path = F.concat(text_of("mem_type"), F.lit("/"), text_of("mem_date"), F.lit("-"), slug, F.lit(".md"))
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("type: "), text_of("mem_type")), F.concat(F.lit("date: "), text_of("mem_date")), F.concat(F.lit("status: "), F.coalesce("status", F.lit("active"))), given("author", "author: "), F.concat(F.lit("tags: [skein, "), text_of("mem_type"), F.lit("]")), F.lit("---"))
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), text_of("title")), given("context", "## Context\n"), F.concat(F.lit("## Content\n"), text_of("content")), given("reasoning", "## Reasoning\n"), given("alternatives", "## Alternatives\n"), given("impact", "## Impact\n"))
    return memories.select("mem_no", path.alias("path"), F.concat(front, F.lit("\n\n"), body, F.lit("\n")).alias("raw"))


def copied(memories: DataFrame) -> DataFrame:
    """(mem_no, text): every record as it is copied with others, separated by --- lines."""
    text = F.concat_ws("\n\n", F.concat(F.lit("## ["), F.upper(text_of("mem_type")), F.lit("] "), text_of("title")), given("context", "**Context**: "), text_of("content"), given("reasoning", "**Reasoning**: "), F.lit("---"))
    return memories.select("mem_no", text.alias("text"))


def display(memories: DataFrame) -> DataFrame:
    """(mem_no, text): a record as an answer to a recall: type, title and date, then content and reasons."""
    head = F.concat(F.lit("["), text_of("mem_type"), F.lit("] "), text_of("title"), F.lit(" ("), text_of("mem_date"), F.lit(")"))
    return memories.select("mem_no", F.concat_ws("\n", head, text_of("content"), given("reasoning", "Why: "), given("impact", "Impact: ")).alias("text"))


LINKS = re.compile(r"^<!--links\n[\s\S]*?\n-->", re.MULTILINE)


def with_links(raw: str, implementations: list[dict]) -> str:
    """A record's text with its links block replaced, inserted at the top, or, for no links, removed."""
    found = LINKS.search(raw)
    if not implementations:
        return raw if found is None else raw[: found.start()] + raw[found.end() :].lstrip("\n")
    block = "<!--links\n" + json.dumps({"implementations": implementations}, indent=2, ensure_ascii=False) + "\n-->"
    return block + "\n" + raw if found is None else raw[: found.start()] + block + raw[found.end() :]


def without_auto_links(memories: DataFrame) -> DataFrame:
    """memories with links that were not confirmed automatically; null where none is left."""
    kept = F.filter("links.implementations", lambda x: ~x["confirmed_by"].eqNullSafe(F.lit("auto")))
    links = F.when(F.size(kept) > 0, F.struct(kept.alias("implementations")))
    return memories.withColumn("links", links)
