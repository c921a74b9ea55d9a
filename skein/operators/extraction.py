"""The way from conversations to records: which ones, what of their text, the model call and its answer."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import jstext
from skein.functions.jstext import trim

#: The record types.
TYPES = ("decision", "architecture", "convention", "todo", "issue")


# --- which conversations ------------------------------------------------------------------------


def without_ignored(conversations: DataFrame, ignored: DataFrame) -> DataFrame:
    """conversations (conv_id, title) without those whose id or title is in ignored (name)."""
    names = ignored.where("name is not null").select(F.col("name").alias("__n")).distinct()
    by_id = conversations.join(names, F.col("conv_id") == F.col("__n"), "left_anti")
    return by_id.join(names, F.col("title") == F.col("__n"), "left_anti")


def picked(conversations: DataFrame, positions: str) -> DataFrame:
    """The conversations at 1-based positions of the listing by newest modified_at, then conv_id.

    positions is a list like "1,3". One that is no positive number makes the result empty,
    numbers beyond the list are left out. No more rows than the largest position are ranked.
    """
    wanted = [p.strip() for p in positions.split(",")]
    if not all(re.fullmatch(r"[1-9]\d*", p) for p in wanted):
        return conversations.limit(0)
    numbers = sorted({int(p) for p in wanted})
    top = conversations.orderBy(F.desc_nulls_last("modified_at"), "conv_id").limit(numbers[-1])
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("modified_at"), "conv_id"))
    return top.withColumn("__p", place).where(F.col("__p").isin(numbers)).drop("__p")


def with_prefix(conversations: DataFrame, prefix: str) -> DataFrame:
    """The conversations whose id starts with a prefix, in any case."""
    return conversations.where(F.startswith(F.lower("conv_id"), F.lit(prefix.lower())))


UNITS = {"m": "minutes", "minute": "minutes", "h": "hours", "hour": "hours", "d": "days", "day": "days", "w": "weeks", "week": "weeks"}


def since_instant(text: str, now: datetime) -> datetime | None:
    """The instant of "3 days ago", "2w", "yesterday" or a date, None for anything else."""
    text = text.strip().lower()
    if text in ("today", "yesterday"):
        return now.replace(hour=0, minute=0, second=0, microsecond=0) - timedelta(days=text == "yesterday")
    span = re.fullmatch(r"(\d+)\s*(m|minute|h|hour|d|day|w|week)s?(?:\s+ago)?", text)
    if span:
        return now - timedelta(**{UNITS[span[2]]: int(span[1])})
    try:
        day = datetime.fromisoformat(text.replace("z", "+00:00"))
    except ValueError:
        return None
    return day if day.tzinfo else day.replace(tzinfo=timezone.utc)


def since(conversations: DataFrame, text: str, now: datetime) -> DataFrame:
    """The conversations whose modified_ms is not before an instant; none where the text gives no instant."""
    start = since_instant(text, now)
    return conversations.limit(0) if start is None else conversations.where(F.col("modified_ms") >= int(start.timestamp() * 1000))


def incremental(conversations: DataFrame, state: DataFrame, manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Conversations (conv_id, modified_ms) that are new, changed after processed_ms, or whose record files are gone.

    state has (conv_id, processed_ms), manifest (source_id, path), existing (path).
    """
    old = state.groupBy(F.col("conv_id").alias("__c")).agg(F.max("processed_ms").alias("__p"))
    alive = manifest.join(existing.select("path").distinct(), "path", "left_semi").select(F.col("source_id").alias("__a")).distinct()
    joined = conversations.join(old, F.col("conv_id") == F.col("__c"), "left").join(alive, F.col("conv_id") == F.col("__a"), "left")
    due = F.col("__c").isNull() | (F.col("modified_ms") > F.col("__p")) | F.col("__a").isNull()
    return joined.where(due).select(*conversations.columns)


def long_enough(conversations: DataFrame, state: DataFrame, least: int = 2) -> DataFrame:
    """conversations (conv_id, turns) with action: process, mark (too short; counts as processed) or skip (no new turns)."""
    old = state.groupBy(F.col("conv_id").alias("__c")).agg(F.max("turn_count").alias("__n"))
    joined = conversations.join(old, F.col("conv_id") == F.col("__c"), "left")
    action = F.when(F.coalesce("turns", F.lit(0)) < least, "mark").when(F.col("turns") <= F.col("__n"), "skip").otherwise("process")
    return joined.select(*conversations.columns, action.alias("action"))


# --- redaction rules ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A redaction rule: every match, or its group 1, becomes <REDACTED:name> or the replacement."""

    name: str
    pattern: str
    replacement: str | None = None
    group: int | None = None

    @property
    def mark(self) -> str:
        return f"<REDACTED:{self.name}>" if self.replacement is None else self.replacement


#: Rules that are off unless they are named.
OPTIONAL = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{20,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{20,}"),
    Rule("aws-secret-key", r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+=]{40}(?![A-Za-z0-9/+=])"),
)
#: Shapes of patterns whose matching can take exponential time: a repeat of a group that ends in a repeat.
NESTED_REPEAT = re.compile(r"\((?:\.|\[\^[^\]]*\]|[^()]{1,20})[+*]\)[+*]")


def rule_of(spec) -> tuple[Rule | None, str | None]:
    """(rule, None) of a user's rule, or (None, why it is refused)."""
    if not isinstance(spec, dict):
        return None, "not an object"
    name, js, group = spec.get("name"), spec.get("pattern"), spec.get("group")
    if not isinstance(name, str) or not re.fullmatch(r"[a-z][a-z0-9-]{0,30}", name):
        return None, "the name is not of lower case letters, digits and hyphens"
    if not isinstance(js, str) or not js:
        return None, "the pattern is empty"
    if NESTED_REPEAT.search(js):
        return None, "the pattern repeats a repeat"
    try:
        re.compile(js)
    except re.error as error:
        return None, f"the pattern is no regular expression: {error}"
    if group not in (None, 1):
        return None, "the group is not 1"
    return Rule(name, js, spec.get("replacement"), group), None


def rules_of(config: dict, defaults: tuple[Rule, ...]) -> tuple[list[Rule], list[str]]:
    """The rules of a configuration and what was refused: defaults unless extendDefaults is false, named optional ones, then the user's."""
    chosen = list(defaults) if config.get("extendDefaults", True) else []
    named = config.get("enableOptional") or []
    chosen += [r for r in OPTIONAL if r.name in named]
    refused = []
    for i, spec in enumerate(config.get("rules") or []):
        rule, why = rule_of(spec)
        if rule is None:
            refused.append(f"rule {i}: {why}")
        else:
            chosen.append(rule)
    return chosen, refused


def redaction_on(forced_on: bool | None, forced_off: bool | None, config: dict | None) -> bool:
    """Whether to redact: off wins over on, on over the configuration."""
    return False if forced_off else bool(forced_on) or (config or {}).get("enabled") is True


def first_group(js: str) -> tuple[int, int]:
    """(start, end) of the first capturing group of a pattern, brackets included; (-1, -1) for none."""
    open_, i = [], 0
    while i < len(js):
        c = js[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i += 1
            while js[i] != "]":
                i += 2 if js[i] == "\\" else 1
        elif c == "(":
            open_.append((i, js[i + 1 : i + 2] != "?"))
        elif c == ")":
            start, captures = open_.pop()
            if captures and not any(x for _, x in open_):
                return start, i + 1
        i += 1
    return -1, -1


def java_pattern(rule: Rule) -> tuple[str, str, int]:
    """(pattern, replacement, group of the redacted text) for Java; a group-1 rule keeps what stands around its group."""
    mark = re.sub(r"([\\$])", r"\\\1", rule.mark)
    start, end = first_group(rule.pattern)
    if rule.group != 1 or start < 0:
        return jstext.pattern(rule.pattern), mark, 0
    js = f"({rule.pattern[:start]})({rule.pattern[start:end]})({rule.pattern[end:]})"
    # the pattern's own group stands inside the second one, so what follows it is the fourth
    return jstext.pattern(js), f"$1{mark}$4", 2


HITS = "array<struct<rule:string,hits:bigint,chars:bigint>>"


def redaction(text: Column, rules: list[Rule]) -> Column:
    """(t, hits) of a text: its redacted form, and (rule, hits, chars) of the rules that matched.

    Every rule works on what the rules before it left; a text is rewritten once per rule. Each
    rule is one step of a fold, so that the plan grows with the rules and not faster. Null stays null.
    """
    none = F.array().cast(HITS)

    def of(rule: Rule) -> Callable[[Column], Column]:
        js, new, group = java_pattern(rule)

        def step(s: Column) -> Column:
            found = F.coalesce(F.regexp_extract_all(s["t"], F.lit(js), F.lit(group)), F.array().cast("array<string>"))
            chars = F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
            one = F.array(F.struct(F.lit(rule.name).alias("rule"), F.size(found).cast("bigint").alias("hits"), chars.alias("chars")))
            return F.struct(F.regexp_replace(s["t"], js, new).alias("t"), F.concat(s["hits"], F.when(F.size(found) > 0, one).otherwise(none)).alias("hits"))

        return step

    state = F.struct(text.alias("t"), none.alias("hits"))
    for rule in rules:
        # transform binds the state once, so that a rule's output is not computed for every use of it
        state = F.transform(F.array(state), of(rule))[0]
    return state


def redacted(df: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """df with its text redacted and the array hits."""
    bound = df.withColumn("__r", redaction(F.col(text), rules))
    return bound.withColumn(text, F.col("__r.t")).withColumn("hits", F.col("__r.hits")).drop("__r")


def audit_trail(hits: Column) -> Column:
    """[redacted: 2 email, 1 jwt], '' where nothing was redacted."""
    parts = F.transform(hits, lambda h: F.concat(h["hits"].cast("string"), F.lit(" "), h["rule"]))
    return F.when(F.size(hits) > 0, F.concat(F.lit("[redacted: "), F.array_join(parts, ", "), F.lit("]"))).otherwise("")


# --- the model ----------------------------------------------------------------------------------

RESULT = "mem_type string, title string, context string, content string, reasoning string, alternatives string, impact string"


def parsed_results(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """answers with one row per record of the JSON list in `answer`: pos and the fields of RESULT.

    A fence around the list is cut. Texts that are no list, elements without type, title or
    content, and elements of an unknown type give no rows.
    """
    bare = F.regexp_replace(F.regexp_replace(F.col(answer), r"^\s*```[\w-]*\s*\n?", ""), r"\n?\s*```\s*$", "")
    listed = answers.withColumn("__v", F.try_variant_get(F.try_parse_json(bare), "$", "array<variant>"))
    each = listed.select(*(c for c in answers.columns if c != answer), F.posexplode("__v").alias("pos", "__e"))
    field = lambda name: F.try_variant_get("__e", f"$.{name}", "string")
    rows = each.select(*(c for c in each.columns if c != "__e"), field("type").alias("mem_type"), *(field(n).alias(n) for n in ("title", "context", "content", "reasoning", "alternatives", "impact")))
    sound = F.col("mem_type").isin(*TYPES) & (F.coalesce("title", F.lit("")) != "") & (F.coalesce("content", F.lit("")) != "")
    return rows.where(sound)


def prompt(text: Column, known_titles: Column, language: str = "en") -> Column:
    """The question to a model for the records of a text; at most 50 known titles are named, so that they are not found again."""
    ask = {"en": "List the decisions, architecture, conventions, todos and issues of this conversation as a JSON list of objects with type, title, context, content, reasoning, alternatives and impact.", "zh": "请以 JSON 列表给出此对话中的决策、架构、约定、待办和问题，每项含 type、title、context、content、reasoning、alternatives、impact。"}[language]
    known = F.slice(F.coalesce(known_titles, F.array().cast("array<string>")), 1, 50)
    note = F.when(F.size(known) > 0, F.concat(F.lit("\n\nAlready known:\n- "), F.array_join(known, "\n- "))).otherwise("")
    return F.concat(F.lit(ask), note, F.lit("\n\n---\n"), text)


def called(df: DataFrame, key: str, text: str, ask: Callable[[str], str], retries: int = 2, wait: float = 3.0) -> DataFrame:
    """(key, answer, error): the answer of `ask` to every text, tried again after wait, 2 * wait, ... seconds.

    ask is called inside the tasks, one text at a time; how many calls run at once is the number
    of tasks, which repartitioning df bounds. A text whose last try fails has a null answer and
    the error's text; null texts are not asked. What is sent has no control characters.
    """
    kind = df.schema[key].dataType.simpleString()

    def one(t: str) -> tuple[str | None, str | None]:
        error = None
        for attempt in range(retries + 1):
            try:
                return ask(t), None
            except Exception as e:  # noqa: BLE001 - any failure of a service is the row's result
                error = f"{type(e).__name__}: {e}"
                if attempt < retries:
                    time.sleep(wait * (attempt + 1))
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *(one(t) if t is not None else (None, None))) for k, t in zip(batch["key"], batch["text"])]
            yield pd.DataFrame(rows, columns=["key", "answer", "error"])

    asked = df.select(F.col(key).alias("key"), jstext.sanitised(F.col(text)).alias("text"))
    return asked.mapInPandas(run, f"key {kind}, answer string, error string").withColumnRenamed("key", key)


def embedded(df: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]], rows_a_call: int = 20) -> DataFrame:
    """(key, vector): the vector of every text from `embed`, which takes lists of at most rows_a_call texts."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["text"].notna()]
            for i in range(0, len(batch), rows_a_call):
                part = batch.iloc[i : i + rows_a_call]
                yield pd.DataFrame({"key": part["key"], "vector": embed(list(part["text"]))})

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, vector array<float>").withColumnRenamed("key", key)


#: Environment names of the model services, in the order in which they are tried.
PROVIDERS = ("AI_REVIEW_API_KEY", "OPENAI_API_KEY", "ANTHROPIC_API_KEY", "OLLAMA_HOST", "LM_STUDIO_URL")


def provider(env: dict[str, str]) -> tuple[str, str | None] | None:
    """(setting, model) of the first service that an environment names; None for none.

    The third service speaks the common protocol only behind a base URL of its own.
    """
    for name in PROVIDERS:
        if env.get(name) and (name != "ANTHROPIC_API_KEY" or env.get("ANTHROPIC_BASE_URL")):
            return name, env.get("MODEL")
    return None


def author(named: str | None, configured: str | None, of_git: str | None, of_system: str | None) -> str:
    """The author whose folder records go to: the first of these whose slug is not empty, else unknown."""
    for name in (named, configured, of_git, of_system):
        slug = re.sub(r"-+", "-", re.sub(r"\s+", "-", re.sub(r"[^\w一-鿿\s-]", "", (name or "").strip().lower(), flags=re.ASCII))).strip("-")[:40]
        if slug:
            return slug
    return "unknown"


def enabled(config: dict, source: str) -> bool:
    """Whether a source is read: yes unless the configuration says no."""
    return (config.get("sources") or {}).get(source, {}).get("enabled", True) is not False


def config_of(text: str | None, defaults: dict) -> tuple[dict, str | None]:
    """The configuration of a JSON text over the defaults (sources, extract and output one level deep), and a warning where it cannot be read."""
    try:
        own = json.loads(text) if text else {}
        if not isinstance(own, dict):
            raise ValueError("not an object")
    except ValueError as error:
        return dict(defaults), f"configuration ignored: {error}"
    out = {**defaults, **own}
    for part in ("sources", "extract", "output"):
        if isinstance(defaults.get(part), dict) or isinstance(own.get(part), dict):
            out[part] = {**(defaults.get(part) or {}), **(own.get(part) if isinstance(own.get(part), dict) else {})}
    return out, None


def turn_texts(messages: DataFrame, least: int = 30) -> DataFrame:
    """(conv_id, msg_id, turn, line): the cleaned lines that a conversation's text is made of, in turn order.

    User turns, and assistant turns of `least` characters or more, with the speaker in front.
    """
    rows = messages.where("role in ('user', 'assistant') and text is not null and conv_id is not null").select("conv_id", "msg_id", "turn", "role", trim(F.col("text")).alias("t"))
    rows = rows.where((F.col("t") != "") & ~((F.col("role") == "assistant") & (F.length("t") < least)))
    name = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    return rows.select("conv_id", "msg_id", "turn", F.concat(name, jstext.denoised(F.col("t"))).alias("line"))
