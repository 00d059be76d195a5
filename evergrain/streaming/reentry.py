"""Rows that come back when they change: keyed state over streams, and watermarks of runs that may end early.

reentering() keeps for every row of every stream the time up to which it has been handled. A version that is newer goes on,
again and again as the row changes; repeated and older versions do not. With a settling time a version waits in state until
the row has been quiet for that long in event time, and a newer version takes its place.

Watermarks stand in a Store: a run takes the next slice of rows after its stream's cursor, and its outcome and the new cursor
are published together, so a run that ends early has advanced past what it did and no further.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from evergrain.operators.ops import after_cursor
from evergrain.sources.store import Store

#: The state store that transformWithState needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Versions(StatefulProcessor):
    """State of a row: the time handled, and where versions settle, the one that waits."""

    def __init__(self, ts_col: str, columns: list[str], settle_ms: int | None):
        self.ts_col, self.columns, self.settle_ms = ts_col, columns, settle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.handled = handle.getValueState("handled", "at long")
        if self.settle_ms is not None:
            self.waiting = handle.getValueState("waiting", "at long, row string")

    def _newest(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """The newest version; of equal times the one that reads least, whatever the order of arrival."""
        whole = pd.concat(list(rows), ignore_index=True)  # the versions of one row in one batch
        at = whole[self.ts_col]
        last = whole[at == at.max()].drop_duplicates()
        return last.loc[[last.astype(str).agg("\x00".join, axis=1).idxmin()]]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = self._newest(rows)
        at = int(newest[self.ts_col].iat[0].timestamp() * 1_000_000)
        done = self.handled.get()[0] if self.handled.exists() else None
        if done is not None and at <= done:
            return
        if self.settle_ms is None:
            self.handled.update((at,))
            yield newest[self.columns]
            return
        if self.waiting.exists():
            if at <= self.waiting.get()[0]:
                return
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.waiting.update((at, newest[self.columns].to_json(orient="records", date_format="iso", date_unit="us")))
        self.handle.registerTimer(at // 1000 + self.settle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.settle_ms is None or not self.waiting.exists():
            return
        at, text = self.waiting.get()
        self.waiting.clear()
        self.handled.update((at,))
        import io

        rows = pd.read_json(io.StringIO(text), orient="records", dtype=False, convert_dates=False)
        rows[self.ts_col] = pd.to_datetime(rows[self.ts_col], utc=True).dt.tz_localize(None)
        yield rows[self.columns]

    def close(self) -> None:
        pass


def reentering(rows: DataFrame, by: list[str], ts_col: str, late: str = "1 hour", settle: str | None = None) -> DataFrame:
    """Each row of a stream (with `by` its identity and ts_col when it last changed) once for each time that it changes.

    settle: how long (as "10 minutes") a row must have been quiet in event time; late: how far behind the newest event a change may come.
    """
    out = StructType([rows.schema[c] for c in rows.columns])
    settle_ms = None if settle is None else int(pd.Timedelta(settle).total_seconds() * 1000)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    watched = rows.withWatermark(ts_col, late) if settle is not None else rows
    made = _Versions(ts_col, rows.columns, settle_ms)
    return watched.groupBy(*by).transformWithStateInPandas(statefulProcessor=made, outputStructType=out, outputMode="Append", timeMode="None" if settle is None else "EventTime")


class Watermarks:
    """Cursors (time, id) of streams, each published with what was done up to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = Store(spark, root)

    def of(self, stream: str) -> tuple[str, str] | None:
        found = ((self.store.current() or {}).get("cursors") or {}).get(stream)
        return None if found is None else (found[0], found[1])

    def next_slice(self, rows: DataFrame, stream: str, ts_col: str, id_col: str, most: int) -> DataFrame:
        """The first `most` rows after the stream's cursor in order of (ts_col, id_col), both strings."""
        cursor = self.of(stream)
        left = rows if cursor is None else after_cursor(rows, ts_col, id_col, *cursor)
        return left.orderBy(ts_col, id_col).limit(most)

    def commit(self, done: DataFrame, outcome: DataFrame, stream: str, ts_col: str, id_col: str) -> tuple[str, str] | None:
        """Publishes the outcome of handled rows, the first of a slice as far as a run got, with the cursor past the last of them."""
        now = self.store.current()
        last = done.agg(F.max(F.struct(ts_col, id_col)).alias("c")).first()["c"]
        if last is None:
            return self.of(stream)
        cursors = ((now or {}).get("cursors") or {}) | {stream: [last[0], last[1]]}
        paths = ((now or {}).get("outcomes") or {}) | {stream: ((now or {}).get("outcomes") or {}).get(stream, []) + [self.store.stage(outcome, f"outcome-{stream}")]}
        self.store.publish({"cursors": cursors, "outcomes": paths}, now)
        return last[0], last[1]

    def outcomes(self, stream: str, schema: StructType) -> DataFrame:
        """What the stream's runs have published so far."""
        paths = self.store.current()["outcomes"][stream]
        return self.store.spark.read.schema(schema).parquet(*[f"{self.store.root}/{p}" for p in paths])
