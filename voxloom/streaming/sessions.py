"""Interactive edit sessions and settled view changes as streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CAP = 24
STATE = "done array<long>, undone array<long>"
OUT = "session string, seq long, op string, current long, depth long, redo long"


def step(done: list[int], undone: list[int], op: str, edit: int, cap: int = CAP) -> tuple[list[int], list[int]]:
    """Undo and redo stacks after one event: commit clears redo and keeps the last ``cap`` edits."""
    if op == "undo":
        return (done[:-1], [*undone, done[-1]]) if done else (done, undone)
    if op == "redo":
        return ([*done, undone[-1]][-cap:], undone[:-1]) if undone else (done, undone)
    return [*done, edit][-cap:], []


def _fold(key, frames, state: GroupState):
    done, undone = (list(x) for x in state.get) if state.exists else ([], [])
    out = []
    rows = pd.concat(list(frames))
    for r in rows.sort_values("seq").itertuples():
        done, undone = step(done, undone, r.op, int(r.edit))
        out.append((key[0], int(r.seq), r.op, done[-1] if done else -1, len(done), len(undone)))
    state.update((done, undone))
    yield pd.DataFrame(out, columns=["session", "seq", "op", "current", "depth", "redo"])


def edit_sessions(events: DataFrame) -> DataFrame:
    """State of each session after each event of a stream (session, seq, op: commit/undo/redo, edit).

    A session's state is two stacks of at most ``CAP`` numbers.
    """
    return events.groupBy("session").applyInPandasWithState(_fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def settled_views(events: DataFrame, quiet: str = "96 milliseconds", late: str = "1 second") -> DataFrame:
    """The last value of each burst of view changes (session, ts, value) that a quiet time ends."""
    return (
        events.withWatermark("ts", late)
        .groupBy("session", F.session_window("ts", quiet).alias("w"))
        .agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
        .select("session", "ts", "value")
    )


def follow_catalogue(changes: DataFrame, apply, checkpoint: str):
    """Run ``apply(batch, epoch)`` for each batch of catalogue changes; returns the query."""
    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).start()
