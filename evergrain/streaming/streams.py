"""Structured Streaming forms: deduplication, windows, sessions, deadlines, and the fold of the log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evergrain.operators.fold import fold_routed, routed


def once(stream: DataFrame, id_col: str, ts_col: str, late: str = "1 day") -> DataFrame:
    """Events once for each content id, as long as repeats come within the watermark."""
    return stream.withWatermark(ts_col, late).dropDuplicatesWithinWatermark([id_col])


def tumbling(events: DataFrame, ts_col: str, by: str, width: str, late: str | None = None) -> DataFrame:
    """Counts by key and window, for a batch or (with a watermark) a stream."""
    rows = events.withWatermark(ts_col, late) if late else events
    found = rows.groupBy(F.window(ts_col, width), by).agg(F.count(F.lit(1)).alias("n_events"))
    return found.select(F.col("window.start").alias("window_start"), by, "n_events")


def sliding(events: DataFrame, ts_col: str, by: str, width: str, step: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts_col, late) if late else events
    found = rows.groupBy(F.window(ts_col, width, step), by).agg(F.count(F.lit(1)).alias("n_events"))
    return found.select(F.col("window.start").alias("window_start"), by, "n_events")


def idle_sessions(events: DataFrame, ts_col: str, by: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Activity between pauses of `gap`: start, end, events."""
    rows = events.withWatermark(ts_col, late) if late else events
    found = rows.groupBy(F.session_window(ts_col, gap), by).agg(F.count(F.lit(1)).alias("n_events"))
    return found.select(by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events")


def fold_batches(history: Callable[[], DataFrame], save: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step: beliefs that an event of the batch touches are folded anew from their own histories, and only they are saved.

    history() gives the log with the batch's events in it; save() inserts or updates by belief_id. A batch that comes again
    saves the same rows, so a restarted stream does no harm.
    """

    def step(batch: DataFrame, _: int) -> None:
        events = routed(history())
        touched = events.join(batch.select("id"), "id", "left_semi").where("canonical is not null").select("canonical").distinct()
        save(fold_routed(events.join(touched, "canonical", "left_semi")))

    return step


DEADLINE = "loop_id string, state string, due_at timestamp"
LAST = "due_at timestamp, told boolean"


def deadlines(beats: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One alarm for each loop whose deadline passes without a new beat. beats: loop_id, ts, due_at."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            due, told = state.get
            if not told:
                state.update((due, True))
                yield pd.DataFrame({"loop_id": [key[0]], "state": ["overdue"], "due_at": [due]})
            return
        due = max(pd.Timestamp(d) for part in rows for d in part["due_at"])
        old = state.getOption
        due = max(due, pd.Timestamp(old[0])) if old else due
        state.update((due.to_pydatetime(), False))
        state.setTimeoutTimestamp(max(int(due.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    watched = beats.withWatermark("ts", late)
    return watched.groupBy("loop_id").applyInPandasWithState(run, DEADLINE, LAST, "append", GroupStateTimeout.EventTimeTimeout)


def parse_log(lines: DataFrame, schema: str) -> DataFrame:
    """A stream of JSON lines as event rows; broken lines are skipped."""
    return lines.select(F.from_json("line", schema).alias("e")).where("e is not null").select("e.*")

