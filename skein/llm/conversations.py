"""Message rows to ordered conversations.

Roles are read, delivered copies dropped, instants brought to one unit, and the clocks of the
senders compared: a reply cannot come before its question, nor the next question before the
reply, so every pair of turns that face each other gives a constraint. The shift of a source's
assistant clock is the least-squares solution of all its constraints; it applies where the clock
is visibly skewed. Turns are then merged by the corrected instants, and conversations whose
order still breaks a constraint (no question first, a question without reply) are rejected. No
step gathers a conversation: order, counts and neighbours come from windows over buckets of a
conversation and from partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.personal import lower_bound
from skein.operators.neighbours import with_previous, with_running
from skein.runtime import cut

#: The spellings of the roles.
USER = ("user", "human")
ASSISTANT = ("assistant", "ai", "bot", "cascade")
OTHER = ("system", "tool", "developer")

#: Plausible instants, 2023 to 2026, in seconds; finer units are multiples of these.
FIRST_S, END_S = 1_672_531_200, 1_798_761_600
NS = 10**9

#: A source's clock is skewed if more than this share of its replies comes before their questions,
#: by the lower bound of one standard deviation, so that one reply alone proves nothing, and the
#: shift mends more than REMEDY of the infeasible constraints.
SKEWED, REMEDY = 0.5, 0.5

#: Bucket widths that keep one conversation out of one task.
TURNS_A_BUCKET = 1024
NS_A_BUCKET = 3600 * NS

BLANK = r"[\p{IsWhite_Space}\p{Cf}]"


def visible(text: Column) -> Column:
    """Whether a text shows more than white space and zero-width characters; false for null."""
    return F.coalesce(text.rlike(r"[^\p{IsWhite_Space}\p{Cf}]"), F.lit(False))


def role_of(role: Column) -> Column:
    """user, assistant, other (not a message) or null for no known role; case and outer blanks are ignored."""
    name = F.lower(F.regexp_replace(role, f"^{BLANK}+|{BLANK}+$", ""))
    return F.when(name.isin(*USER), "user").when(name.isin(*ASSISTANT), "assistant").when(name.isin(*OTHER), "other")


def instant_ns(number: Column) -> Column:
    """Nanoseconds since 1970 of a number in whichever unit gives a date from 2023 to 2026, else null."""
    out = F.lit(None).cast("bigint")
    for unit in (1, 10**3, 10**6, 10**9):
        out = F.when((number >= FIRST_S * unit) & (number < END_S * unit), number * F.lit(NS // unit)).otherwise(out)
    return out


def usable_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, source, msg_id, role, chars, turn, ns) of the messages that count, without their texts.

    User and assistant rows with visible text; among rows equal in conversation, role, text, turn
    and sent_at the one with the lowest msg_id. Rows without conv_id are left out. Copies are
    found by a 128-bit digest of the text taken before the shuffle, so that no text is shuffled.
    """
    rows = messages.select("conv_id", "source", "msg_id", role_of(F.col("role")).alias("role"), "text", "turn", "sent_at")
    rows = rows.where(F.col("conv_id").isNotNull() & F.col("role").isin("user", "assistant") & visible(F.col("text")))
    rows = rows.select("conv_id", "source", "msg_id", "role", F.md5("text").alias("digest"), F.length("text").alias("chars"), "turn", "sent_at")
    kept = rows.groupBy("conv_id", "role", "turn", "sent_at", "digest").agg(F.min(F.struct("msg_id", "source", "chars")).alias("m"))
    return kept.select("conv_id", "m.source", "m.msg_id", "role", "m.chars", "turn", instant_ns(F.col("sent_at")).alias("ns"))


def with_texts(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """rows with the text of their (conv_id, msg_id); messages of other conversations are dropped before the join."""
    own = messages.select("conv_id", "msg_id", "text").join(rows.select("conv_id").distinct(), "conv_id", "left_semi")
    return rows.join(own, ["conv_id", "msg_id"])


def reply_constraints(usable: DataFrame) -> DataFrame:
    """(source, least, most, conv_id, place): bounds of a source's assistant shift in ns, null for none.

    A sender's own clock keeps its own order, so the n-th reply faces the n-th question: the
    shift is at least question - reply, and at most next question - reply. Conversations with
    as many replies as questions give all their pairs, others only the first one. Messages
    without instant take no part. Places within a sender come from buckets, not whole conversations.
    """
    timed = usable.where("ns is not null").withColumn("sender", F.to_json(F.struct("conv_id", "role")))
    bucket = F.coalesce(F.floor(F.col("turn") / TURNS_A_BUCKET), F.floor(F.col("ns") / NS_A_BUCKET) + 10**7)
    first = timed.withColumn("at", F.coalesce(F.col("turn").cast("bigint"), F.col("ns")))
    placed = with_running(first, "sender", bucket, ["at", "ns", "msg_id"], F.lit(1), "place").select("conv_id", "source", "role", "ns", "place")
    question, reply = F.col("role") == "user", F.col("role") == "assistant"
    even = placed.groupBy("conv_id").agg((F.count_if(question) == F.count_if(reply)).alias("even"))
    slots = F.when(question, F.array(F.struct(F.col("place").alias("place"), F.lit("q").alias("part")), F.struct((F.col("place") - 1).alias("place"), F.lit("n").alias("part")))).otherwise(
        F.array(F.struct(F.col("place").alias("place"), F.lit("r").alias("part")))
    )
    rows = placed.select("conv_id", "source", "ns", F.explode(slots).alias("s")).select("conv_id", "source", "ns", "s.place", "s.part").where("place >= 0")
    part = lambda x: F.min(F.when(F.col("part") == x, F.col("ns"))).alias(x)
    faced = rows.groupBy("conv_id", "place").agg(F.min("source").alias("source"), part("q"), part("r"), part("n")).where("r is not null and (q is not null or n is not null)")
    faced = faced.join(even, "conv_id").where("even or place = 0")
    return faced.select("source", (F.col("q") - F.col("r")).alias("least"), F.when(F.col("even"), F.col("n") - F.col("r")).alias("most"), "conv_id", "place")


def clock_offsets(usable: DataFrame) -> DataFrame:
    """(source, constraints, infeasible, left_infeasible, offset_ns): the shift of each source's assistant clock.

    The shift minimises the sum of squared lacks over all constraints of the source, which is
    solved by iterating over the set of those it violates until the set stays. It is given only
    where the clock is skewed (SKEWED, REMEDY), else 0.
    """
    bounds = cut(reply_constraints(usable).select("source", "least", "most").where("source is not null"))
    count = lambda d: (F.count_if(F.col("least") > d) + F.count_if(F.col("most") < d))
    early = lower_bound(F.count_if(F.col("least") > 0), F.nullif(F.count("least"), F.lit(0))) > SKEWED
    sums = cut(bounds.groupBy("source").agg((F.count("least") + F.count("most")).alias("constraints"), count(F.lit(0)).alias("infeasible"), F.coalesce(early, F.lit(False)).alias("skewed")))
    shifts = cut(sums.where("skewed").select("source", F.lit(0.0).alias("d"), F.lit(0.0).alias("step")))
    while not shifts.where(F.abs("step") > NS // 1000).isEmpty() or not shifts.where("d = 0 and step = 0").isEmpty():
        held = bounds.join(shifts, "source")
        low, high = F.when(F.col("least") > F.col("d"), F.col("least")), F.when(F.col("most") < F.col("d"), F.col("most"))
        mean = (F.coalesce(F.sum(low.cast("double")), F.lit(0.0)) + F.coalesce(F.sum(high.cast("double")), F.lit(0.0))) / F.nullif(F.count(low) + F.count(high), F.lit(0))
        step = F.coalesce(F.round("mean") - F.col("d"), F.lit(0.0))
        turned = F.signum(step) * F.signum("step") < 0
        moved = held.groupBy("source", "d", "step").agg(mean.alias("mean")).select("source", "d", F.when(turned, step / 2).otherwise(step).alias("step"))
        shifts = cut(moved.select("source", (F.col("d") + F.col("step")).alias("d"), "step"))
    left = bounds.join(shifts, "source").groupBy("source").agg(F.first("d").alias("d"), count(F.col("d")).alias("left_infeasible"))
    joined = sums.join(left, "source", "left")
    mended = F.col("left_infeasible") < (1 - REMEDY) * F.col("infeasible")
    left_over = F.when(mended, F.col("left_infeasible")).otherwise(F.col("infeasible"))
    return joined.select("source", "constraints", "infeasible", left_over.alias("left_infeasible"), F.when(mended, F.col("d")).otherwise(0).cast("bigint").alias("offset_ns"))


def ordered(usable: DataFrame) -> DataFrame:
    """usable with place (turn where filled, else the corrected instant), rank (user before assistant) and bucket.

    Messages with neither turn nor instant come last.
    """
    offsets = clock_offsets(usable).where("offset_ns <> 0").select(F.col("source").alias("__source"), "offset_ns")
    shifted = usable.join(offsets, F.col("source") == F.col("__source"), "left")
    ns = F.col("ns") + F.when(F.col("role") == "assistant", F.coalesce("offset_ns", F.lit(0))).otherwise(F.lit(0))
    place = F.coalesce(F.col("turn").cast("bigint"), ns, F.lit(2**62))
    bucket = F.when(F.col("turn").isNotNull(), F.floor(F.col("turn") / TURNS_A_BUCKET)).otherwise(F.coalesce(F.floor(ns / NS_A_BUCKET) + 10**7, F.lit(2**40)))
    return shifted.select(*usable.columns, place.alias("place"), F.when(F.col("role") == "user", 0).otherwise(1).alias("rank"), bucket.cast("bigint").alias("bucket"))


ORDER = ["place", "rank", "msg_id"]


def verdicts(messages: DataFrame, metas: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """(conv_id, n_usable, n_broken, ends_open, n_unknown, recorded, keep) of every conv_id of either table.

    n_broken counts a first message that is no question and questions that follow a question;
    ends_open says that the last message is a question; n_unknown counts visible rows without a
    known role; recorded is the highest turn_count of the meta rows, null for none. A
    conversation without usable messages is not kept. placed is ordered(usable_messages(messages))
    where that is at hand.
    """
    placed = ordered(usable_messages(messages)) if placed is None else placed
    rows = with_previous(placed, "conv_id", F.col("bucket"), ORDER, ["role"])
    broken = F.when(F.col("role") == "user", F.col("prev_role") == "user").otherwise(F.col("prev_role").isNull())
    place = F.struct(*ORDER)
    chats = rows.groupBy("conv_id").agg(
        F.count("*").alias("n_usable"), F.count_if(F.coalesce(broken, F.lit(False))).alias("n_broken"), (F.max_by("role", place) == "user").alias("ends_open")
    )
    unknown = messages.where("conv_id is not null").groupBy("conv_id").agg(F.count_if(role_of(F.col("role")).isNull() & visible(F.col("text"))).alias("n_unknown"))
    counts = metas.where("conv_id is not null").groupBy("conv_id").agg(F.max("turn_count").alias("recorded"))
    every = unknown.join(chats, "conv_id", "left").join(counts, "conv_id", "full")
    keep = (
        (F.coalesce("n_usable", F.lit(0)) > 0)
        & (F.col("n_broken") == 0)
        & ~F.col("ends_open")
        & (F.coalesce("n_unknown", F.lit(0)) == 0)
        & (F.col("n_usable") >= F.coalesce("recorded", F.lit(0)))
    )
    return every.withColumn("keep", F.coalesce(keep, F.lit(False)))


def rebuilt(messages: DataFrame, metas: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, msg_id) of the kept conversations, positions counted from 0."""
    placed = cut(ordered(cut(usable_messages(messages))))
    rows = placed.join(verdicts(messages, metas, placed).where("keep").select("conv_id"), "conv_id", "left_semi")
    numbered = with_running(rows, "conv_id", F.col("bucket"), ORDER, F.lit(1), "position").select("conv_id", "msg_id", "position", "role")
    return with_texts(numbered, messages).select("conv_id", "position", "role", "text", "msg_id")
