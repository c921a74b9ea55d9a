"""Mixed written times to one form, through a dictionary of distinct values.

A column of times has few distinct texts against its rows. The distinct (text, zone, order, kind)
values are pre-aggregated on the map side, those that the dictionary does not have yet are parsed
once, appended to the dictionary in the shared folder, and the parsed values are joined back to
the rows. Parsing is a pure function of the key, so a lost or repeated append changes nothing.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import instants
from skein.functions.instants import parse
from skein.operators.nested import last_session
from skein.runtime import cut, shared_dir

KEY = ("raw", "zone", "day_first", "as_day")
DICTIONARY = "raw string, zone string, day_first boolean, as_day boolean, norm string"


def parse_distinct(values: DataFrame) -> DataFrame:
    """Adds norm to distinct (raw, zone, day_first, as_day) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = [None if pd.isna(x) else bool(x) for x in b["day_first"]]
            b["day_first"] = pd.array(known, dtype="boolean")
            b["norm"] = [parse(*x) for x in zip(b["raw"], b["zone"], known, b["as_day"])]
            yield b[[*KEY, "norm"]]

    return values.select(*KEY).mapInPandas(run, DICTIONARY)


def dictionary(spark: SparkSession, values: DataFrame, path: str | None) -> DataFrame:
    """(KEY, norm) of the distinct `values`, from the dictionary at `path`, which is extended by those it does not have.

    path=None keeps it in the shared folder, under the digest of the parser's source, so that
    no version of the parser reads what another one wrote. The dictionary is read once and
    never shuffled as a whole beyond the join with the values. Two jobs that append at once may
    write a value twice; such repeats are dropped from the values that meet them.
    """
    version = hashlib.sha256(inspect.getsource(instants).encode()).hexdigest()[:16]
    path = path or f"{shared_dir(spark).rstrip('/')}/skein_times/{version}"
    try:
        known = spark.read.schema(DICTIONARY).parquet(path)
        match = [F.col(f"v.{c}").eqNullSafe(F.col(f"k.{c}")) for c in KEY]
        condition = match[0]
        for m in match[1:]:
            condition &= m
        joined = values.alias("v").join(known.withColumn("hit", F.lit(True)).alias("k"), condition, "left").select(*(F.col(f"v.{c}").alias(c) for c in KEY), "k.norm", "k.hit")
        met = cut(joined.dropDuplicates(list(KEY)))
        old, fresh = met.where("hit").drop("hit"), met.where("hit is null")
    except AnalysisException:
        old, fresh = None, values
    parsed = cut(parse_distinct(fresh))
    parsed.write.mode("append").parquet(path)
    return parsed if old is None else old.unionByName(parsed)


def normalise(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Adds norm to rows that have raw, zone, day_first and as_day; any other columns pass through.

    norm is null where raw is null, blank or denotes no time. Rows are never dropped or doubled.
    """
    spark = rows.sparkSession
    values = rows.where("raw is not null").select(*KEY).distinct()
    words = dictionary(spark, values, path).select(*(F.col(c).alias(f"__{c}") for c in KEY), F.col("norm").alias("norm"))
    condition = F.col("raw") == F.col("__raw")
    for c in KEY[1:]:
        condition &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(words, condition, "left").drop(*(f"__{c}" for c in KEY))


def creation_dates(files: DataFrame) -> DataFrame:
    """(file_id, author, raw, is_number) of each file's session; a JSON number is written out in full digits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file_id, author, text in zip(b["file_id"], b["author"], b["raw"]):
                session = last_session(text)
                value = None if session is None else session.get("creationDate")
                if isinstance(value, bool) or not isinstance(value, (str, int, float)):
                    continue
                out.append((file_id, author, value if isinstance(value, str) else repr(value), not isinstance(value, str)))
            yield pd.DataFrame(out, columns=["file_id", "author", "raw", "is_number"])

    return files.select("file_id", "author", "raw").mapInPandas(run, "file_id bigint, author string, raw string, is_number boolean")


def written_times(commits: DataFrame, metas: DataFrame, files: DataFrame, memories: DataFrame, authors: DataFrame) -> DataFrame:
    """(src, row_id, raw, zone, day_first, as_day) of every time of the four tables."""
    by_slug = authors.select(F.col("author").alias("__a"), F.col("tz").alias("zone"), "day_first").dropDuplicates(["__a"])
    by_name = authors.select(F.col("display_name").alias("__a"), F.col("tz").alias("zone"), "day_first").dropDuplicates(["__a"])

    def part(df: DataFrame, src: str, key: str, raw: str, people: DataFrame, as_day: bool = False) -> DataFrame:
        named = df.select(F.lit(src).alias("src"), F.col(key).cast("bigint").alias("row_id"), F.col(raw).alias("raw"), F.col("author").alias("__author"))
        joined = named.join(people, F.col("__author") == F.col("__a"), "left")
        return joined.select("src", "row_id", "raw", "zone", "day_first", F.lit(as_day).alias("as_day"))

    return (
        part(commits, "commit", "commit_no", "commit_date", by_name)
        .unionByName(part(metas, "meta", "meta_no", "modified_at", by_slug))
        .unionByName(part(creation_dates(files), "session", "file_id", "raw", by_slug))
        .unionByName(part(memories, "memory", "mem_no", "mem_date", by_slug, as_day=True))
    )
