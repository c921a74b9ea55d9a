"""Column expressions for texts with JavaScript's meaning of blanks, word boundaries and case.

Java's \\b and \\s differ from what the records were written with: \\b is Unicode there and ASCII
here, and \\s lacks the no-break and ideographic spaces. All patterns below spell both out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WB = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
NWB = r"(?:(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<![A-Za-z0-9_])(?![A-Za-z0-9_]))"
CJK = r"一-鿿㐀-䶿豈-﫿"


def pattern(js: str) -> str:
    """A JavaScript pattern for Java: ASCII word boundaries and JavaScript blanks."""
    return js.replace(r"\B", NWB).replace(r"\b", WB).replace(r"\S", "[^" + WS[1:]).replace(r"\s", WS)


def trim(text: Column) -> Column:
    """Text without outer blanks."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def count(text: Column, js: str) -> Column:
    """How often a JavaScript pattern matches; null for null."""
    return F.regexp_count(text, F.lit(pattern(js)))


# --- similarity ---------------------------------------------------------------------------------


def squeezed(text: Column) -> Column:
    """Lower case, runs of blanks as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), f"{WS}+", " "))


def shingles(text: Column, n: int = 3) -> Column:
    """The distinct character n-grams of a squeezed text; empty below n characters and for null."""
    none = F.array().cast("array<string>")

    def of(flat: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(flat) - (n - 1)), lambda i: F.substring(flat, i, F.lit(n)))
        return F.when(F.length(flat) >= n, F.array_distinct(grams)).otherwise(none)

    # The squeezed text is bound once; written into the inner lambda it would be made again for every gram.
    return F.flatten(F.transform(F.array(squeezed(F.coalesce(text, F.lit("")))), of))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets: 1 if both are empty, 0 if one is."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def containment(a: Column, b: Column) -> Column:
    """The share of a's elements that b has; 1 if a is empty."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


#: Verbs that may lead a title.
TITLE_VERBS = "使用|采用|选择|引入|改为|切换到|use|adopt|switch to|choose"


def normal_title(title: Column) -> Column:
    """Lower case without a leading verb, blanks and marks; word characters and CJK stay."""
    bare = F.regexp_replace(F.lower(title), f"^(?:{TITLE_VERBS}){WS}+", "")
    return F.regexp_replace(bare, r"[^A-Za-z0-9_一-鿿]", "")


# --- quality ------------------------------------------------------------------------------------

#: Phrases too general to be useful, and patterns that show technical detail.
VAGUE_ZH = [
    "影响到整个项目", "优化了用户体验", "提高了效率", "改善了性能", "影响到整个", "确保系统稳定", "提高代码质量", "优化了整体", "影响到项目的", "符合最佳实践", "遵循最佳实践", "影响较大", "提升了开发效率", "保证了代码质量", "确保了系统",
    "增强了功能", "方便了开发", "简化了流程", "实现了功能", "满足了需求", "对项目有重要意义", "是一个好的选择",
]
VAGUE_EN = [
    "affects the entire project", "improves user experience", "improves efficiency", "improves performance", "ensures system stability", "improves code quality",
    "follows best practices", "affects the whole", "is a good choice", "enhances the functionality", "simplifies the process", "meets the requirements",
    "is important for the project", "makes development easier", "ensures code quality", "improves the overall",
]
SPECIFIC = [
    r"[./\\][\w-]+\.\w{1,5}\b",
    r"(?:function|class|interface|type|const|let|var|def|fn|func|struct|enum)\s+\w+",
    r"\b[a-z_][\w]*\([^)]*\)",
    r"/api/[\w/]+",
    r"/v\d+/",
    r"`[^`\n]{2,}`",
    r"(?:config|process\.env|import|require|from)\s*[.(]\s*['\"]?\w+",
    r"\b\w+\.(?:ts|tsx|js|jsx|mjs|cjs|py|go|rs|rb|java|kt|swift|c|cpp|h|hpp|json|yaml|yml|toml|ini|env|md|mdx|sql|sh|bash|zsh|ps1|css|scss|sass|html|vue|svelte|astro|xml|csv|proto)\b",
    r"https?://\S+",
    r"\blocalhost:\d+",
    r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|JOIN|WHERE|GROUP BY|ORDER BY)\b",
    r"\b(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+/[\w/-]*",
    r"\bv?\d+\.\d+(?:\.\d+)?(?:-[\w.]+)?\b",
    r"[\w-]+/[\w-]+(?:/[\w.-]+)+",
    r"\B--[a-z][\w-]*",
    r"\B-[a-zA-Z]\b",
    r"(?i)\b[a-z][\w]*(?:-[\w]+){1,}\b",
    r"\b[A-Z][A-Z0-9_]{2,}\b",
    r"\$\{?\w+\}?",
    r"\bnpm\s+(?:install|i|run|publish|version)\b",
    r"\bgit\s+(?:add|commit|push|pull|merge|rebase|checkout|log|diff|status|tag)\b",
]


def specificity(text: Column) -> Column:
    """The number of technical details in a text, over all patterns; 0 for null."""
    return reduce(lambda a, b: a + b, (F.coalesce(count(text, p), F.lit(0)) for p in SPECIFIC))


def is_vague(content: Column, impact: Column) -> Column:
    """Whether a record says nothing concrete: a vague phrase or too short a text without any detail."""
    detail, length = specificity(content), F.length(content)
    phrase = reduce(lambda a, b: a | b, (F.contains(F.lower(content), F.lit(p)) for p in VAGUE_ZH + VAGUE_EN))
    thin = (length < 80) | ((length < 200) & (specificity(impact) == 0))
    return F.coalesce((detail == 0) & (phrase | thin), F.lit(False))


def title_likeness(title: Column, content: Column) -> Column:
    """How much a content only repeats its title, 0 to 1."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_一-鿿]", "")
    t, c = bare(title), bare(content)
    short = F.when(F.length(t) <= F.length(c), t).otherwise(c)
    long = F.when(F.length(t) <= F.length(c), c).otherwise(t)
    inside = F.contains(long, short)
    ratio = F.length(short) / F.length(long)
    return F.when((t == "") | (c == ""), 0.0).when(t == c, 1.0).when(inside & (F.length(t) <= F.length(c)) & (ratio > 0.7), 1.0).when(inside & (ratio > 0.8), 0.9).otherwise(0.0)


def quality_reason(title: Column, content: Column, impact: Column) -> Column:
    """Why a record is dropped, first reason first: short, duplicate, vague; null where it stays."""
    return F.when(F.coalesce(F.length(content), F.lit(0)) < 30, "short").when(title_likeness(title, content) > 0.8, "duplicate").when(is_vague(content, impact), "vague")


# --- search -------------------------------------------------------------------------------------

#: Words that carry no meaning of their own.
STOPWORDS_EN = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall",
    "should", "may", "might", "must", "can", "could", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "and",
    "but", "or", "nor", "not", "no", "so", "if", "then", "than", "that", "this", "it", "its", "i", "we", "you", "he", "she", "they", "my", "your",
    "his", "her", "our", "their", "me", "him", "us", "them",
]
STOPWORDS_CJK = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这",
]


def keywords(text: Column) -> Column:
    """The distinct search words of a text: Latin words of two characters or more that are no stop words, and CJK characters, pairs and triples."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    latin = F.filter(F.split(F.regexp_replace(lower, f"[{CJK}]", " "), f"{WS}+"), lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS_EN))
    runs = F.regexp_extract_all(lower, F.lit(f"([{CJK}]+)"), F.lit(1))

    def grams(run: Column, n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, F.lit(n)))
        return F.when(F.length(run) >= n, cut).otherwise(F.array().cast("array<string>"))

    each = F.transform(runs, lambda r: F.concat(F.filter(grams(r, 1), lambda g: ~g.isin(*STOPWORDS_CJK)), F.filter(grams(r, 2), lambda g: ~g.isin(*STOPWORDS_CJK)), grams(r, 3)))
    return F.array_distinct(F.concat(latin, F.flatten(each)))


#: What a keyword in each field counts.
FIELD_WEIGHTS = {"title": 10.0, "content": 5.0, "context": 2.0, "reasoning": 1.0, "impact": 1.0}
TYPE_WEIGHT = 3.0


def keyword_score(words: list[str], type_column: str = "mem_type") -> Column:
    """The keyword score of a record for the words of a query; longer words count more, except in the type."""
    terms = []
    for word in words:
        bonus = 2.0 if len(word) >= 3 else 1.2 if len(word) == 2 else 1.0
        for field, weight in FIELD_WEIGHTS.items():
            terms.append(F.when(F.contains(F.lower(F.coalesce(F.col(field), F.lit(""))), F.lit(word)), F.lit(weight * bonus)).otherwise(0.0))
        terms.append(F.when(F.contains(F.lower(F.coalesce(F.col(type_column), F.lit(""))), F.lit(word)), F.lit(TYPE_WEIGHT)).otherwise(0.0))
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def recency(day: Column, as_of: str) -> Column:
    """exp(-days / 90) before as_of, 1 after it, 0 where the text is no YYYY-MM-DD day."""
    days = F.datediff(F.lit(as_of).cast("date"), F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day.try_cast("date")))
    return F.when(days.isNull(), 0.0).when(days < 0, 1.0).otherwise(F.exp(-days / 90.0))


# --- cleaning -----------------------------------------------------------------------------------

#: What conversation noise is replaced by, in order.
NOISE = [
    (r"<(?:tool_call|antml:invoke|function_call)[^>]*>[\s\S]*?</(?:tool_call|antml:invoke|function_call)>", "[tool call]"),
    (r"<(?:tool_result|function_result)[^>]*>[\s\S]*?</(?:tool_result|function_result)>", "[tool output]"),
    (r"\b[0-9a-fA-F]{32,}\b", "[hash]"),
    (r"\b[A-Za-z0-9+/]{40,}={0,2}\b", "[base64]"),
    (r"data:[^;]+;base64,[A-Za-z0-9+/=]+", "[data-uri]"),
]
LONG_LINE, KEPT = 500, 120


def denoised(text: Column) -> Column:
    """Text without tool calls and outputs, hashes, encoded data, the tails of very long lines, and more than two blank lines."""
    for js, name in NOISE:
        text = F.regexp_replace(text, pattern(js).replace(f"[{WS}[^{WS[1:]}]", "[\\s\\S]"), name)
    short = lambda line: F.when(F.length(line) >= LONG_LINE, F.concat(F.substring(line, 1, KEPT), F.lit("... [truncated "), F.length(line).cast("string"), F.lit(" chars]"))).otherwise(line)
    return F.regexp_replace(F.array_join(F.transform(F.split(text, "\n"), short), "\n"), "\n{4,}", "\n\n\n")


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def sanitised(text: Column) -> Column:
    """Text without control characters (tab and line ends stay) and characters beyond the basic plane."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{10000}-\x{10FFFF}]", "")


# --- names and keys -----------------------------------------------------------------------------


def slug(title: Column) -> Column:
    """A file name part of at most 60 characters; untitled for nothing."""
    kept = F.regexp_replace(F.lower(title), rf"[^A-Za-z0-9_一-鿿\-{WS[1:]}", "")
    joined = F.regexp_replace(F.regexp_replace(trim(kept), f"{WS}+", "-"), "-+", "-")
    cut = F.regexp_replace(F.substring(joined, 1, 60), "-$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", "untitled").otherwise(cut)


def author_slug(name: Column) -> Column:
    """An author's folder of at most 40 characters."""
    kept = F.regexp_replace(F.lower(trim(name)), rf"[^A-Za-z0-9_一-鿿\-{WS[1:]}", "")
    joined = F.regexp_replace(F.regexp_replace(kept, f"{WS}+", "-"), "-+", "-")
    return F.substring(F.regexp_replace(joined, "^-+|-+$", ""), 1, 40)


def memory_id(kind: Column, title: Column, day: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of type:title:date; null parts count as ''."""
    parts = [F.coalesce(c, F.lit("")) for c in (kind, title, day)]
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def node_id(kind: Column, day: Column, title: Column) -> Column:
    """type:date:title with anything but letters, digits, CJK, : and - as _, at most 120 characters."""
    parts = [F.coalesce(c, F.lit("")) for c in (kind, day, title)]
    return F.substring(F.regexp_replace(F.concat_ws(":", *parts), r"[^a-zA-Z0-9:一-鿿\-]", "_"), 1, 120)


def embed_text(kind: Column, title: Column, content: Column, context: Column, reasoning: Column, impact: Column) -> Column:
    """What is embedded of a record, at most 8000 characters."""
    head = F.concat(F.lit("["), F.coalesce(kind, F.lit("")), F.lit("] "), F.coalesce(title, F.lit("")))
    rest = [F.nullif(c, F.lit("")) for c in (context, reasoning, impact)]
    return F.substring(F.concat_ws("\n", head, F.coalesce(content, F.lit("")), *rest), 1, 8000)
