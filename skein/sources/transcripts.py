"""Chat transcripts of several layouts as rows (path, turn, role, text).

Lines come from one text column per file or line and are read as VARIANT in the JVM; unreadable
lines and lines of other kinds give no rows. Turns are numbered by their line, so that no file is
sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.jstext import WS, trim


def lines(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, line_no, line) of all files under a folder; line_no orders a file's lines."""
    whole = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def _value(path: str, kind: str = "string"):
    return F.try_variant_get("v", path, kind)


def _parts(path: str, kinds: tuple[str, ...], clean: bool = False):
    """The text parts of a list of {type, text}, joined by line ends; the text itself where it is a string."""
    listed = F.try_variant_get("v", path, "array<struct<type string, text string>>")
    wanted = F.filter(listed, lambda p: p["type"].isin(*kinds) & p["text"].isNotNull())
    texts = F.transform(wanted, lambda p: unwrapped(p["text"]) if clean else trim(p["text"]))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def unwrapped(text):
    """What stands between user_query tags, trimmed; the text itself where there are none."""
    inner = F.regexp_extract(text, rf"(?s)<user_query>{WS}*(.*?){WS}*</user_query>", 1)
    return F.when(text.rlike(r"(?s)<user_query>.*?</user_query>"), trim(inner)).otherwise(text)


def _turns(df: DataFrame, role, text) -> DataFrame:
    rows = df.select("path", "line_no", role.alias("role"), trim(text).alias("text"))
    return rows.where(F.col("role").isin("user", "assistant") & (F.col("text") != "")).select("path", F.col("line_no").alias("turn"), "role", "text")


def editor_jsonl(rows: DataFrame) -> DataFrame:
    """Lines {role, message: {content: [parts]}}; content must be a list, user_query tags are unwrapped."""
    v = rows.withColumn("v", F.try_parse_json("line"))
    return _turns(v, _value("$.role"), _parts("$.message.content", ("text",), clean=True))


def agent_jsonl(rows: DataFrame) -> DataFrame:
    """Lines {role, message: {content} or content}; content is a string or a list of parts."""
    v = rows.withColumn("v", F.try_parse_json("line"))
    in_message = F.schema_of_variant(_value("$.message.content", "variant")).isNotNull()
    is_list = lambda p: F.coalesce(F.schema_of_variant(_value(p, "variant")).startswith("ARRAY"), F.lit(False))
    one = lambda p: F.when(is_list(p), _parts(p, ("text",))).otherwise(_value(p))
    return _turns(v, _value("$.role"), F.when(in_message, one("$.message.content")).otherwise(one("$.content")))


def rollout_jsonl(rows: DataFrame) -> DataFrame:
    """Lines of type response_item with a message payload, and compacted lines as assistant turns; all else is dropped."""
    v = rows.withColumn("v", F.try_parse_json("line"))
    message = (_value("$.type") == "response_item") & (_value("$.payload.type") == "message")
    compacted = _value("$.type") == "compacted"
    is_list = F.coalesce(F.schema_of_variant(_value("$.payload.content", "variant")).startswith("ARRAY"), F.lit(False))
    content = F.when(is_list, _parts("$.payload.content", ("input_text", "output_text"))).otherwise(_value("$.payload.content"))
    role = F.when(message, _value("$.payload.role")).when(compacted, "assistant")
    return _turns(v, role, F.when(message, content).when(compacted, _value("$.payload.message")))


def labelled_text(files: DataFrame) -> DataFrame:
    """(path, raw) texts whose turns follow lines `user:` or `assistant:`; the first text after a label is its turn."""
    marked = F.regexp_replace("raw", rf"(?m)^(user|assistant):[ \t]*\r?$", "\x00$1\x01")
    blocks = files.select("path", F.posexplode(F.split(marked, "\x00")).alias("turn", "block"))
    parts = F.split("block", "\x01", 2)
    rows = blocks.where(F.contains("block", F.lit("\x01"))).select("path", "turn", parts[0].alias("role"), unwrapped(trim(parts[1])).alias("text"))
    return rows.where("text <> ''")


#: The roles that chats from a database use.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "cascade": "assistant"}


def database_chats(rows: DataFrame) -> DataFrame:
    """(path, chat, turn, role, text) of (path, raw) values: a list of chats, {conversations | sessions | chats} or one chat {messages | turns | steps}."""
    v = rows.withColumn("v", F.try_parse_json("raw"))
    first = lambda names, kind: F.coalesce(*(_value(f"$.{n}", kind) for n in names))
    chats = F.coalesce(_value("$", "array<variant>"), first(("conversations", "sessions", "chats"), "array<variant>"), F.array("v"))
    each = v.select("path", F.posexplode(chats).alias("chat", "v"))
    turns = each.select("path", "chat", F.posexplode(first(("messages", "turns", "steps"), "array<variant>")).alias("turn", "v"))
    name = F.lower(first(("role", "type", "sender"), "string"))
    role = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))[name]
    is_list = lambda p: F.coalesce(F.schema_of_variant(_value(p, "variant")).startswith("ARRAY"), F.lit(False))
    text = F.coalesce(*(F.nullif(trim(F.when(is_list(p), _parts(p, ("text",))).otherwise(_value(p))), F.lit("")) for p in ("$.content", "$.text", "$.message", "$.visible")))
    return turns.select("path", "chat", "turn", role.alias("role"), text.alias("text")).where("role is not null and text is not null")


def titles(turns: DataFrame) -> DataFrame:
    """(path, title): the first user turn on one line, cut to 57 characters and ... where it is longer than 60."""
    first = turns.where("role = 'user'").groupBy("path").agg(F.min_by("text", "turn").alias("t"))
    flat = trim(F.regexp_replace("t", f"{WS}+", " "))
    return first.select("path", F.when(F.length(flat) > 60, F.concat(F.substring(flat, 1, 57), F.lit("..."))).otherwise(flat).alias("title"))
