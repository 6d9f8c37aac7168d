"""Custom state in event-time order: rows wait in their time slot until the watermark has passed it.

A key's rows are kept as they come, in chunks named by their earliest slot; nothing is judged on arrival. A timer at the end of the earliest slot fires once
no earlier row can come. Then the chunks that are due are taken one after the other; what lies before the next chunk is sorted and fed to
a step function with the key's small state. Results therefore do not depend on file order, on the size of micro-batches or on how rows of
a key are cut into batches; rows later than the watermark allows are dropped by Spark before they get here. Chunks of more than ``CHUNK`` rows
are cut by slot, so that a task holds about one slot of one key at a time, however many rows a key has.

After ``forget`` without rows a key is removed, so that state follows the keys that are alive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
CHUNK = 2000  # rows of several slots that may be kept together

#: step(state, rows in order) -> (state, result rows); the state is a tuple or None at the start
Step = Callable[[tuple | None, pd.DataFrame], tuple[tuple | None, pd.DataFrame]]


class InOrder(StatefulProcessor):
    """Rows (us, event_id, tag) of a key in order of (us, event_id)."""

    def __init__(self, step: Step, state_schema: str, slot_ms: int, forget_ms: int):
        self.step, self.state_schema, self.slot_ms, self.forget_ms = step, state_schema, slot_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "slot bigint, chunk bigint", "us array<bigint>, event_id array<bigint>, tag array<string>")
        self.chunks = handle.getValueState("chunks", "n bigint, last_us bigint")
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, last = self.chunks.get() if self.chunks.exists() else (0, 0)
        earliest = None
        for pdf in rows:
            slot = pdf["us"] // (self.slot_ms * 1000)
            for own in [pdf] if len(pdf) <= CHUNK else [part for _, part in pdf.groupby(slot)]:
                first, n, last = self._keep(own, n), n + 1, max(last, int(own["us"].max()))
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.chunks.update((n, last))
            self.handle.registerTimer((earliest + 1) * self.slot_ms)
        return iter(())

    def _keep(self, rows: pd.DataFrame, number: int) -> int:
        """Store a chunk under its earliest slot."""
        first = int(rows["us"].min()) // (self.slot_ms * 1000)
        tag = [None if pd.isna(t) else str(t) for t in rows["tag"]]
        self.held.updateValue((first, number), (rows["us"].tolist(), rows["event_id"].tolist(), tag))
        return first

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        n, last = self.chunks.get() if self.chunks.exists() else (0, 0)
        over = now // self.slot_ms  # slots before this one are due
        waiting = sorted(tuple(k) for k in self.held.keys())
        due = [k for k in waiting if k[0] < over]
        before = state = tuple(self.state.get()) if due and self.state.exists() else None
        rows, at = None, 0
        while at < len(due) or (rows is not None and len(rows)):
            parts = [] if rows is None else [rows]
            if at < len(due):
                own = [k for k in due[at:] if k[0] == due[at][0]]
                for k in own:
                    parts.append(pd.DataFrame(dict(zip(("us", "event_id", "tag"), map(list, self.held.getValue(k))))))
                    self.held.removeKey(k)
                at += len(own)
            rows = pd.concat(parts, ignore_index=True)
            slot = rows["us"] // (self.slot_ms * 1000)
            ready = slot < (min(over, due[at][0]) if at < len(due) else over)
            if ready.any():
                state, out = self.step(state, rows[ready].sort_values(["us", "event_id"], kind="stable", ignore_index=True))
                if len(out):
                    yield out
                rows = rows[~ready]
            if at == len(due):
                break
        if state != before:
            self.state.update(state)
        left = [k[0] for k in waiting[len(due) :]]
        if rows is not None and len(rows):  # slots of a chunk that are not due yet
            left.append(self._keep(rows, n))
            self.chunks.update((n + 1, last))
        if left:
            self.handle.registerTimer((min(left) + 1) * self.slot_ms)
        elif self.chunks.exists():
            gone = last // 1000 + self.forget_ms
            if gone <= now:
                for kept in (self.held, self.chunks, self.state):
                    kept.clear()
            else:
                self.handle.registerTimer(gone)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, tag: Column, step: Step, state_schema: str, result: str, late: str, slot_hours: int = 24, forget_days: int = 365) -> DataFrame:
    """Feed the rows of each key to ``step`` in order of (ts, event_id). ``late`` is how far behind the newest row one may come."""
    ready = rows.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("us"), "event_id", tag.cast("string").alias("tag"))
    processor = InOrder(step, state_schema, slot_hours * 3_600_000, forget_days * DAY_MS)
    return ready.groupBy(key).transformWithStateInPandas(processor, result, "append", "eventtime")


class Expiry(StatefulProcessor):
    """One result for a key without a terminal row within the limit after its first row.

    The timer of the limit fires when no row of that time can come any more, so the answer is final. What stays is a tombstone: later rows of the key
    change nothing. It goes ``remember_ms`` after the key's last row."""

    def __init__(self, limit_ms: int, remember_ms: int):
        self.limit_ms, self.remember_ms = limit_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "born_us bigint, ended_us bigint, last_us bigint, closed boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        born, ended, last, closed = self.life.get() if self.life.exists() else (None, None, 0, False)
        before = born
        for pdf in rows:
            first = int(pdf["us"].min())
            born = first if born is None else min(born, first)
            last = max(last, int(pdf["us"].max()))
            ends = pdf.loc[pdf["ended"], "us"]
            if len(ends):
                ended = int(ends.min()) if ended is None else min(ended, int(ends.min()))
        self.life.update((born, ended, last, closed))
        if not closed and born != before:
            self.handle.registerTimer(born // 1000 + self.limit_ms + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.life.exists():
            return
        born, ended, last, closed = self.life.get()
        limit = born + self.limit_ms * 1000
        now = timerValues.getCurrentWatermarkInMs()
        if not closed and limit // 1000 < now:
            closed = True
            self.life.update((born, ended, last, closed))
            if ended is None or ended > limit:
                yield pd.DataFrame({"key": [key[0]], "created_us": [born], "expired_us": [limit]})
        if closed:
            gone = last // 1000 + self.remember_ms
            if gone <= now:
                self.life.clear()
            else:
                self.handle.registerTimer(gone)

    def close(self) -> None:
        pass


def expiring(rows: DataFrame, key: str, ended: Column, hours: int, late: str, remember_days: int = 30) -> DataFrame:
    """(key, created_us, expired_us) of the keys without an ``ended`` row within ``hours`` after their first row."""
    kind = rows.schema[key].dataType.simpleString()
    ready = rows.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("us"), F.coalesce(ended, F.lit(False)).alias("ended"))
    processor = Expiry(hours * 3_600_000, remember_days * DAY_MS)
    return ready.groupBy(key).transformWithStateInPandas(processor, f"key {kind}, created_us bigint, expired_us bigint", "append", "eventtime")
