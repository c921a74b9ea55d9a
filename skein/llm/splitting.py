"""Oversized texts to pieces that end at natural boundaries and repeat the end of the piece before.

Texts start as atomic segments. Adjacent pairs wait in a heap, weakest boundary first, and merge
while their combined size plus the overlap fits the limit; what no merge joined any more are the
pieces. A boundary between paragraphs or messages is the strongest, so that all merges inside
paragraphs come before any across them and need only their own message: these run message by
message, and only the sizes of what they leave are gathered for the merges of a conversation.
Texts are cut out and put together piece by piece, so that one conversation may be larger than
any task.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.conversations import ORDER, ordered, usable_messages, with_texts
from skein.runtime import cut

TURN_LIMIT, TURN_OVERLAP = 8_000, 800
CONVERSATION_LIMIT, CONVERSATION_OVERLAP = 20_000, 2_000
JOINT = "\n\n"

#: Boundaries from strong to weak: where a segment may end, as patterns of the end of a segment.
LEVELS = [
    (6, re.compile(r"(?:\r?\n[ \t]*){2,}")),
    (5, re.compile(r"\r?\n")),
    (4, re.compile(r"(?:[.!?…]+[\"')\]”’»]*\s+|[。！？]+[」』”’）]*)")),
    (3, re.compile(r"(?:[;:,]\s+|[；：，、])")),
    (2, re.compile(r"\s+")),
    (1, re.compile(r"(?<=[⺀-鿿가-힯])(?=[⺀-鿿가-힯])|[/\-_=&]+")),
]
HARD, PARAGRAPH = 0, 6


def atoms(text: str, room: int, level: int = 0) -> Iterator[tuple[str, int]]:
    """(segment, strength of the boundary at its end) of a text, each segment at most `room` long.

    Text is cut into sentences; a segment that is still too long is cut at the next weaker
    boundaries, and one without any at `room`, never before a combining mark.
    """
    if level >= len(LEVELS):
        start = 0
        while len(text) - start > room:
            end = start + room
            while end > start + 1 and re.match(r"[̀-ͯ‍️]", text[end]):
                end -= 1
            yield text[start:end], HARD
            start = end
        yield text[start:], HARD
        return
    strength, pattern = LEVELS[level]
    start = 0
    for found in [*pattern.finditer(text), None]:
        end = len(text) if found is None else found.end()
        if end <= start:
            continue
        part = text[start:end]
        if level < 2 or len(part) > room:
            inner = list(atoms(part, room, level + 1))
            yield from inner[:-1]
            yield inner[-1][0], strength if found is not None else inner[-1][1]
        else:
            yield part, strength
        start = end


def grouped(size: list[int], ends: list[int], limit: int, overlap: int, least: int = HARD, most: int = PARAGRAPH) -> list[tuple[int, int]]:
    """(first, last) of the segments that belong together: adjacent groups merged, weakest boundary and then smallest pair first, while they fit.

    size has the segments' sizes, ends the strength of the boundary at each end; only boundaries
    of strength least to most are merged across.
    """
    n, size = len(size), list(size)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive, last = [True] * n, list(range(n))
    heap = [(ends[i], size[i] + size[i + 1], i, size[i], size[i + 1]) for i in range(n - 1) if least <= ends[i] <= most]
    heapq.heapify(heap)
    while heap:
        _, total, i, left, right = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or size[i] != left or size[j] != right or total + overlap > limit:
            continue
        size[i], last[i], after[i], alive[j] = total, last[j], after[j], False
        for p in (i, before[i]):
            if p >= 0 and after[p] < n and least <= ends[last[p]] <= most:
                heapq.heappush(heap, (ends[last[p]], size[p] + size[after[p]], p, size[p], size[after[p]]))
        if after[i] < n:
            before[after[i]] = i
    return [(i, last[i]) for i in range(n) if alive[i]]


def merged(segments: list[tuple[str, int]], limit: int, overlap: int) -> list[str]:
    """The pieces of a text's segments, all boundaries in one heap."""
    groups = grouped([len(s) for s, _ in segments], [e for _, e in segments], limit, overlap)
    return ["".join(s for s, _ in segments[i : j + 1]) for i, j in groups]


def pieces(text: str, limit: int, overlap: int) -> list[str]:
    """The own parts of the pieces of a text; joined they are the text. Texts within the limit are one piece."""
    return [text] if len(text) <= limit else merged(list(atoms(text, limit - overlap)), limit, overlap)


def with_overlap(own: list[str], overlap: int) -> list[str]:
    """Each piece with the last `overlap` characters of the piece before in front."""
    out, previous = [], ""
    for part in own:
        previous = (previous[-overlap:] if overlap else "") + part
        out.append(previous)
    return out


PIECES = "item_kind string, item_id string, piece int, own_length int, text string"


def split_texts(df: DataFrame, kind: str, key: str, text: str, limit: int = TURN_LIMIT, overlap: int = TURN_OVERLAP) -> DataFrame:
    """Pieces of every text longer than `limit`, as (item_kind, item_id, piece, own_length, text).

    Null, empty and shorter texts give no rows; equal rows each give theirs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, whole in zip(batch["item"], batch["text"]):
                own = pieces(whole, limit, overlap)
                out += [(kind, item, i, len(o), p) for i, (o, p) in enumerate(zip(own, with_overlap(own, overlap)))]
            yield pd.DataFrame(out, columns=["item_kind", "item_id", "piece", "own_length", "text"])

    long = df.where(F.length(text) > limit).select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))
    return long.mapInPandas(run, PIECES)


def paragraphs(text: str, last: bool, limit: int, overlap: int) -> tuple[list[int], list[int]]:
    """(sizes, ends) of what all merges inside paragraphs leave of a message; the joint to the next message belongs to its end.

    ends is PARAGRAPH where the conversation's merges may go on, else HARD.
    """
    segments = list(atoms(text if last else text + JOINT, limit - overlap))
    if not last:
        segments[-1] = (segments[-1][0], PARAGRAPH)
    size, ends = [len(s) for s, _ in segments], [e for _, e in segments]
    groups = grouped(size, ends, limit, overlap, most=PARAGRAPH - 1)
    return [sum(size[i : j + 1]) for i, j in groups], [PARAGRAPH if ends[j] == PARAGRAPH else HARD for _, j in groups]


def spans(sizes: list[list[int]], ends: list[list[int]], limit: int, overlap: int) -> list[tuple[int, int, int, int, bool]]:
    """(piece, message, start, stop, own) for the messages of a conversation: the characters that each piece takes from each message.

    Starts and stops count from the start of the message, the joint after it included. own is
    false for what repeats the `overlap` characters before the piece.
    """
    flat = [s for m in sizes for s in m]
    groups = grouped(flat, [e for m in ends for e in m], limit, overlap, least=PARAGRAPH)
    at = [0, *accumulate(flat)]
    edges = [0, *accumulate(sum(m) for m in sizes)]
    out: list[tuple[int, int, int, int, bool]] = []

    def take(piece: int, start: int, stop: int, own: bool) -> None:
        m = bisect_right(edges, start) - 1
        while start < stop:
            upto = min(stop, edges[m + 1])
            if upto > start:
                out.append((piece, m, start - edges[m], upto - edges[m], own))
            start, m = upto, m + 1

    for piece, (i, j) in enumerate(groups):
        take(piece, max(0, at[i] - overlap), at[i], False)
        take(piece, at[i], at[j + 1], True)
    return out


def split_conversations(messages: DataFrame, limit: int = CONVERSATION_LIMIT, overlap: int = CONVERSATION_OVERLAP) -> DataFrame:
    """Pieces of every conversation whose usable messages, joined by two line feeds, are longer than `limit`.

    (item_kind, item_id, piece, own_length, text). The pieces are those of one heap over the
    whole conversation, in which a message's end is a paragraph's end. A task holds the sizes of
    a conversation's paragraphs, no texts of it but those of one piece.
    """
    usable = cut(usable_messages(messages))
    sized = usable.groupBy("conv_id").agg((F.sum("chars") + len(JOINT) * (F.count("*") - 1)).alias("total")).where(F.col("total") > limit)
    rows = ordered(usable).join(sized.select("conv_id"), "conv_id", "left_semi").select("conv_id", *ORDER)
    final = rows.groupBy("conv_id").agg(F.max(F.struct(*ORDER)).alias("end")).select("conv_id", F.col("end.msg_id").alias("end_id"))
    rows = rows.join(final, "conv_id").select("conv_id", *ORDER, (F.col("msg_id") == F.col("end_id")).alias("is_last"))
    texts = cut(with_texts(rows, messages).dropDuplicates(["conv_id", "msg_id"]))

    @F.pandas_udf("struct<sizes array<int>, ends array<int>>")
    def measured(text: pd.Series, last: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([paragraphs(t, x, limit, overlap) for t, x in zip(text, last)], columns=["sizes", "ends"])

    parts = texts.select("conv_id", *ORDER, measured("text", "is_last").alias("m")).select("conv_id", *ORDER, "m.sizes", "m.ends")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(ORDER, kind="stable")
        ids = group["msg_id"].to_numpy()
        found = spans([list(x) for x in group["sizes"]], [list(x) for x in group["ends"]], limit, overlap)
        out = [(key[0], piece, ids[m], i, start, stop, own) for i, (piece, m, start, stop, own) in enumerate(found)]
        return pd.DataFrame(out, columns=["conv_id", "piece", "msg_id", "place", "start", "stop", "own"])

    taken = parts.groupBy("conv_id").applyInPandas(run, "conv_id string, piece int, msg_id bigint, place int, start int, stop int, own boolean")
    joint = F.when(F.col("is_last"), F.col("text")).otherwise(F.concat("text", F.lit(JOINT)))
    whole = texts.select("conv_id", "msg_id", joint.alias("text"))
    bits = taken.join(whole, ["conv_id", "msg_id"]).select("conv_id", "piece", "place", "own", F.expr("substring(text, start + 1, stop - start)").alias("bit"))
    joined = bits.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(F.struct("place", "bit"))).alias("bits"), F.sum(F.when(F.col("own"), F.length("bit")).otherwise(0)).cast("int").alias("own_length"))
    text = F.array_join(F.transform("bits", lambda b: b["bit"]), "")
    return joined.select(F.lit("conversation").alias("item_kind"), F.col("conv_id").alias("item_id"), "piece", "own_length", text.alias("text"))
