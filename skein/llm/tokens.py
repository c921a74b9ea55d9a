"""Texts to the ids of a public byte-level BPE tokenizer, and back."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of the vocabulary files, and the pattern that splits text before merges.
TOKENIZERS = "/opt/tokenizers"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Longer texts are cut at safe boundaries before encoding.
LONG = 20_000


def rank_bytes(name: str = "byte_bpe_50k", folder: str | None = None) -> bytes:
    """The rank file of a tokenizer, read on the driver; its size is that of the vocabulary."""
    with open(os.path.join(folder or os.environ.get("SKEIN_TOKENIZERS", TOKENIZERS), f"{name}.tiktoken"), "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def encoding(ranks: bytes):
    """The tokenizer of a rank file, built once per worker; it knows no special tokens."""
    import tiktoken

    lines = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("skein", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})


#: Where no match of PATTERN reaches over: before blanks, and between letters, digits and marks; an apostrophe may lead a word's ending.
SAFE = regex.compile(
    r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=[^\p{White_Space}\p{L}])|(?<=\p{N})(?=[^\p{White_Space}\p{N}])|(?<=[^\p{White_Space}\p{L}\p{N}'])(?=[\p{L}\p{N}])"
)


def safe_pieces(text: str, limit: int = LONG) -> Iterator[str]:
    """Pieces of about `limit` characters whose ids, one after the other, are those of the text.

    Cuts are made at the first SAFE place from the limit on. Only a run of one class of
    characters (letters, digits, marks or blanks) is longer: it is one unit of the tokenizer.
    """
    start = 0
    while len(text) - start > limit:
        cut = SAFE.search(text, start + limit)
        if cut is None or cut.start() >= len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(enc, text: str) -> list[int]:
    """The ids of a text; strings of special tokens in it are ordinary text."""
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text):
        ids.extend(enc.encode_ordinary(piece))
    return ids


def with_ids(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids) of every row: the ids of its text, [] for an empty or null text.

    Whole texts are encoded, long ones piece by piece; equal rows each give their row. The rank
    file is broadcast from the driver, so executors need no copy of it.
    """
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(rank_bytes(name, folder))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                all_ids = [np.array(encode(enc, t) if t else [], dtype=np.int32) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(all_ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in all_ids], out=offsets[1:])
                flat = np.concatenate(all_ids) if all_ids else np.zeros(0, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat)], ["key", "ids"])

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.select(F.col("key").alias(key), "ids")


def with_counts(df: DataFrame, text: str, out: str = "n_tokens", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """df with the number of tokens of its text column, 0 for an empty or null text."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_bytes(name, folder))

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(ranks.value)
        return texts.map(lambda t: len(encode(enc, t)) if t else 0).astype("int64")

    return df.withColumn(out, count(F.col(text)))


def decoded(df: DataFrame, ids: str, out: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """df with the text of its ids. Bytes are joined before they are read as UTF-8, so characters cut between ids come back whole; ids that form no UTF-8 give U+FFFD, unknown ids null."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_bytes(name, folder))

    @F.pandas_udf("string")
    def read(column: pd.Series) -> pd.Series:
        enc = encoding(ranks.value)

        def one(x):
            if x is None:
                return None
            try:
                return enc.decode_bytes([int(i) for i in x]).decode("utf-8", "replace")
            except KeyError:
                return None

        return column.map(one)

    return df.withColumn(out, read(F.col(ids)))


def ids_of(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, ids) of documents."""
    return with_ids(documents, "doc_id", "text")
