"""Incremental processing of growing conversations with Structured Streaming.

Files of conversation snapshots (conv_id, modified_ms, turn_count) arrive; every micro-batch is
compared with a state table in the shared folder, changed conversations are handed on, and the
state is written anew under the batch's number, so that a repeated batch writes the same state;
the states before the one that a repeat would read are removed. For many conversations of which
few change, skein.streaming.changes keeps the state by key instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "conv_id string, processed_ms bigint, turn_count int"


def batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches whose state is complete, in order; the folder is listed once."""
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=") and fs.exists(jvm.Path(f"{path}/{n}/_SUCCESS")))


def read_state(spark: SparkSession, path: str, before: int) -> DataFrame:
    """The state after the last batch before `before`, empty where there is none."""
    known = [b for b in batches(spark, path) if b < before]
    return spark.read.schema(STATE).parquet(f"{path}/batch={known[-1]}") if known else spark.createDataFrame([], STATE)


def drop_states(spark: SparkSession, path: str, before: int) -> None:
    """Removes the states of batches before the one that a repeat of batch `before` would read."""
    jvm = spark._jvm.org.apache.hadoop.fs
    for b in [b for b in batches(spark, path) if b < before][:-1]:
        old = jvm.Path(f"{path}/batch={b}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def due(snapshots: DataFrame, state: DataFrame, least_turns: int = 2) -> DataFrame:
    """(conv_id, modified_ms, turn_count, from_turn) of conversations that have new turns.

    The newest snapshot of a conversation counts. Conversations below least_turns or without
    more turns than were processed are left out, as are snapshots not newer than the state.
    """
    newest = snapshots.where("conv_id is not null").groupBy("conv_id").agg(F.max(F.struct("modified_ms", "turn_count")).alias("s")).select("conv_id", "s.modified_ms", "s.turn_count")
    old = state.select(F.col("conv_id").alias("__c"), "processed_ms", F.col("turn_count").alias("__n"))
    joined = newest.join(old, F.col("conv_id") == F.col("__c"), "left")
    fresh = F.col("processed_ms").isNull() | (F.col("modified_ms") > F.col("processed_ms"))
    more = F.col("turn_count") > F.coalesce("__n", F.lit(0))
    return joined.where(fresh & more & (F.col("turn_count") >= least_turns)).select("conv_id", "modified_ms", "turn_count", F.coalesce("__n", F.lit(0)).alias("from_turn"))


def next_state(snapshots: DataFrame, state: DataFrame) -> DataFrame:
    """The state after a batch: conversations too short to process count as seen, with the turns processed before."""
    newest = snapshots.where("conv_id is not null").groupBy("conv_id").agg(F.max(F.struct(F.col("modified_ms").alias("processed_ms"), "turn_count")).alias("s")).select("conv_id", "s.*")
    return state.unionByName(newest).groupBy("conv_id").agg(F.max("processed_ms").alias("processed_ms"), F.max("turn_count").alias("turn_count"))


def watch(snapshots: DataFrame, state_path: str, checkpoint: str, handle: Callable[[DataFrame, int], None], least_turns: int = 2):
    """Starts the query over a streaming DataFrame; handle gets every batch's due conversations. It ends when all files are read."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = read_state(spark, state_path, number)
        handle(due(batch, state, least_turns), number)
        next_state(batch, state).write.mode("overwrite").parquet(f"{state_path}/batch={number}")
        drop_states(spark, state_path, number)

    return snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
