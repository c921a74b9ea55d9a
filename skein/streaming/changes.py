"""Changed conversations as a stream, with the state of every conversation in Spark's state store.

The state holds, by conversation, the newest instant seen and the turns processed; a micro-batch
touches only the conversations in it, and the checkpoint makes a repeated batch give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "conv_id string, modified_ms bigint, turn_count int, from_turn int"
STATE = "seen_ms bigint, turns int"


def changes(snapshots: DataFrame, least_turns: int = 2, record_first: bool = False) -> DataFrame:
    """(conv_id, modified_ms, turn_count, from_turn) of conversations that have new turns.

    snapshots is a stream of (conv_id, modified_ms, turn_count). Snapshots not newer than the
    last one seen are dropped, whatever their order. With record_first the first sight of a
    conversation is only recorded, so that a watch that starts on a full folder processes what
    changes from then on. Conversations below least_turns count as seen.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [(int(m), int(n)) for p in parts for m, n in zip(p["modified_ms"], p["turn_count"]) if pd.notna(m) and pd.notna(n)]
        seen, turns = state.get if state.exists else (None, 0)
        if not rows:
            return
        newest, count = max(rows)
        if seen is not None and newest <= seen:
            return
        only_record = record_first and seen is None
        due = not only_record and count >= least_turns and count > turns
        state.update((newest, max(turns, count) if due or only_record else turns))
        if due:
            yield pd.DataFrame([(key[0], newest, count, turns)], columns=["conv_id", "modified_ms", "turn_count", "from_turn"])

    keyed = snapshots.where("conv_id is not null").select("conv_id", "modified_ms", "turn_count")
    return keyed.groupBy("conv_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run(due: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Starts handing the due conversations of every batch to `handle`.

    every="60 seconds" polls for ever; a short interval gathers the events of an editor that
    saves often. Without it everything that is there is processed and the query ends, which is
    what a daily job calls.
    """
    writer = due.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
