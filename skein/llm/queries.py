"""Queries of the operators for training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import conversations, mixing, neighbours, oracle, personal, residue, splitting, tokens
from skein.runtime import table


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every oversized turn and conversation."""
    messages = table(spark, d, "chat_messages")
    return splitting.split_texts(messages, "turn", "msg_id", "text").unionByName(splitting.split_conversations(messages))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The oversized items: those that the splitting gave a second piece."""
    return p2_pieces(spark, d).where("piece = 1").select("item_kind", "item_id")


def p3_spans(spark: SparkSession, d: str) -> DataFrame:
    """(src, row_id, start, end, kind) of all personal information in turns and memories."""
    texts = personal.texts_of(table(spark, d, "chat_messages"), table(spark, d, "memories"))
    return personal.found_spans(texts, table(spark, d, "authors"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of personal information in every record that has any."""
    return p3_spans(spark, d).select("src", "row_id", F.col("kind").alias("pii_kind")).distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Turns and memories with typed placeholders instead of personal information."""
    texts = personal.texts_of(table(spark, d, "chat_messages"), table(spark, d, "memories"))
    return personal.redacted(texts, personal.found_spans(texts, table(spark, d, "authors")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Conversations that must be dropped."""
    found = conversations.verdicts(table(spark, d, "chat_messages"), table(spark, d, "conversation_meta"))
    return found.where("not keep").select("conv_id")


def p4_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The kept conversations, message by message."""
    return conversations.rebuilt(table(spark, d, "chat_messages"), table(spark, d, "conversation_meta"))


def p4_clock_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The shift of each source's assistant clock."""
    return conversations.clock_offsets(conversations.usable_messages(table(spark, d, "chat_messages")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Similar pairs of vectors of one model."""
    return neighbours.similar_pairs(table(spark, d, "vector_entries"))


def p7_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar ids of every usable vector: by codes where these are sure, else by exact search."""
    return neighbours.nearest(table(spark, d, "vector_entries"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.ids_of(spark, table(spark, d, "documents"))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, same): whether decoding a document's ids gives its text back, '' for null."""
    texts = table(spark, d, "documents")
    back = tokens.decoded(tokens.ids_of(spark, texts), "ids", "back")
    return texts.select("doc_id", "text").join(back.select("doc_id", "back"), "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, copies): the documents of every mix."""
    return mixing.select(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source of every mix."""
    return mixing.shares(*mixing.select(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold residue instead of content."""
    return residue.marked(table(spark, d, "documents")).where("residue").select("doc_id")


def p10_corpus(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, lang) of the corpus that is left."""
    return residue.clean_corpus(table(spark, d, "documents")).select("doc_id", "source", "lang")


QUERIES = {
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_spans": p3_spans,
    "p3_redacted": p3_redacted,
    "p4_found": p4_found,
    "p4_conversations": p4_conversations,
    "p4_clock_offsets": p4_clock_offsets,
    "p7_found": p7_found,
    "p7_nearest": p7_nearest,
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p9_selection": p9_selection,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_corpus": p10_corpus,
}
SQL = oracle.SQL
