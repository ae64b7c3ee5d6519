"""Stateful packing of message streams.

A session's state is its next expected message, the open chunk and the messages that came too
early. Messages are assigned in their order whatever order they arrive in; early ones
wait in the state for the gap to close. A message that came before is ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session_id long, message_idx long, length long, chunk_id long"
STATE = "next_idx long, chunk_id long, total long, count long, early_idx array<long>, early_length array<long>"


def pack_stream(messages: DataFrame, max_length: int, first_idx: int = 0) -> DataFrame:
    """(session_id, message_idx, length, chunk_id) from a stream with the first three columns."""

    def update(key, frames, state: GroupState):
        at, chunk, total, count, idx, lengths = state.get if state.exists else (first_idx, 0, 0, 0, [], [])
        waiting = dict(zip(idx, lengths))
        for f in frames:
            for i, n in zip(f["message_idx"].tolist(), f["length"].tolist()):
                if i >= at:
                    waiting.setdefault(i, n)
        rows = []
        while at in waiting:
            n = waiting.pop(at)
            if count and total + n > max_length:
                chunk, total, count = chunk + 1, 0, 0
            total, count = total + n, count + 1
            rows.append((key[0], at, n, chunk))
            at += 1
        left = sorted(waiting)
        state.update((at, chunk, total, count, left, [waiting[i] for i in left]))
        yield pd.DataFrame(rows, columns=["session_id", "message_idx", "length", "chunk_id"])

    return messages.groupBy("session_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
