"""Event-time order for the keyed folds: rows wait in state until the watermark has passed them, silent keys expire.

The rows of a key may come in any order within the watermark's delay. They are kept in list state, and a timer at the
earliest waiting row wakes the key when the watermark reaches it; what the watermark has passed is then folded in order with
the key's small JSON state. A key that has been silent for ``ttl_seconds`` of event time loses its state and starts anew.
Rows behind the watermark are dropped by Spark. Needs the RocksDB state store (``build_session`` sets it).
"""

from __future__ import annotations

import json
from typing import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from segue import rules
from segue.operators.manifests import recent_links_step
from segue.operators.queues import ADMISSION_START, admission_step
from segue.streaming.jobs import REPLAY_START, _single, occupancy_step, replay_step

ROWS = T.StructType([T.StructField("rows", T.BinaryType())])
MEMORY = T.StructType([T.StructField("json", T.StringType()), T.StructField("latest", T.LongType())])


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class OrderedFold(StatefulProcessor):
    """``step(state, rows)`` over the rows of a key in the order of (``at``, ``order``), each row once."""

    def __init__(self, at: str, order: list[str], step: Callable, initial: dict, added: list[str], columns: list[str], ttl_seconds: int | None):
        self.at, self.order, self.step, self.start = at, [at, *order], step, json.dumps(initial)
        self.added, self.columns, self.ttl = added, columns, ttl_seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROWS)
        self.memory = handle.getValueState("memory", MEMORY)

    def close(self) -> None:
        pass

    def _millis(self, rows: pd.DataFrame) -> pd.Series:
        return rows[self.at].astype("datetime64[us]").astype("int64") // 1000

    def _wake(self, millis: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(millis))

    def _advance(self, fresh: list[pd.DataFrame], watermark: int):
        """Fold what the watermark has passed; keep the rest and set the next timer."""
        held = [_unpacked(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = pd.concat([*held, *fresh]) if held or fresh else None
        memory, latest = self.memory.get() if self.memory.exists() else (self.start, 0)
        if rows is not None:
            millis = self._millis(rows)
            ready, later = rows[millis <= watermark], rows[millis > watermark]
            latest = max(latest, int(millis.max()))
            if len(ready):
                ready = ready.sort_values(self.order, kind="stable").reset_index(drop=True)
                state = json.loads(memory)
                values = self.step(state, ready)
                memory = json.dumps(state)
                for k, name in enumerate(self.added):
                    ready[name] = pd.Series([v[k] for v in values], dtype=object)
                yield ready[[*self.columns, *self.added]]
            self.waiting.clear()
            if len(later):
                self.waiting.put([(_packed(later),)])
                self.memory.update((memory, latest))
                self._wake(self._millis(later).min())
                return
        if self.ttl is not None and watermark >= latest + 1000 * self.ttl:
            self.memory.clear()
            return
        self.memory.update((memory, latest))
        if self.ttl is not None:
            self._wake(latest + 1000 * self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        yield from self._advance(list(rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._advance([], timerValues.getCurrentWatermarkInMs())


def ordered_fold_stream(df: DataFrame, key: str, at: str, order: list[str], step: Callable, initial: dict, added: list[tuple[str, T.DataType]],
                        delay: str = "10 minutes", ttl_seconds: int | None = None) -> DataFrame:
    """Append columns computed by ``step(state, rows) -> list of tuples`` per key in event-time order, across batches.

    A row comes out when the watermark (``delay`` behind the latest event time seen) has passed it.
    """
    out = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in added]])
    fold = OrderedFold(at, order, step, initial, [n for n, _ in added], df.columns, ttl_seconds)
    return df.withWatermark(at, delay).groupBy(key).transformWithStateInPandas(
        statefulProcessor=fold, outputStructType=out, outputMode="Append", timeMode="EventTime")


def replay_queue_stream(log: DataFrame, guild: str, at: str, order: list[str], **options) -> DataFrame:
    return ordered_fold_stream(log, guild, at, order, replay_step, REPLAY_START, [
        ("present", T.LongType()), ("looping", T.BooleanType()), ("automix", T.BooleanType()), ("outcome", T.StringType())], **options)


def admit_requests_stream(log: DataFrame, guild: str, at: str, order: list[str], max_queue: int = rules.MAX_QUEUE,
                          max_pending: int = rules.MAX_PENDING, **options) -> DataFrame:
    return ordered_fold_stream(log, guild, at, order, _single(admission_step(max_queue, max_pending)), ADMISSION_START,
                               [("verdict", T.StringType())], **options)


def voice_occupancy_stream(events: DataFrame, guild: str, at: str, order: list[str], **options) -> DataFrame:
    counted = ordered_fold_stream(events, guild, at, order, occupancy_step, {"boot": False, "bot": None, "people": {}},
                                  [("people", T.LongType()), ("decision", T.StringType())], **options)
    return counted.where("kind = 'peer'")


def dedupe_segments_stream(lines: DataFrame, stream: str, at: str, order: list[str], capacity: int = rules.SEGMENT_MEMORY,
                           **options) -> DataFrame:
    flagged = ordered_fold_stream(lines, stream, at, order, _single(recent_links_step(capacity)), {"urls": []},
                                  [("_fresh", T.BooleanType())], **options)
    return flagged.where("_fresh").drop("_fresh")


def _current_step(state: dict, rows: pd.DataFrame) -> list:
    """An event counts if its session and playback are the guild's current ones and it is the first of its kind for them."""
    out = []
    for kind, session, playback in zip(rows["kind"], rows["session"], rows["playback"]):
        now = [int(session), int(playback)]
        if kind == "started":
            state.update(now=now, seen=[])
            out.append((True,))
        else:
            live = state["now"] == now and kind not in state["seen"]
            if live:
                state["seen"].append(kind)
            out.append((live,))
    return out


def drop_stale_events_stream(events: DataFrame, guild: str, at: str, order: list[str], **options) -> DataFrame:
    """events(kind, session, playback): what ``started`` made current decides which later events count, in event-time order."""
    flagged = ordered_fold_stream(events, guild, at, order, _current_step, {"now": None, "seen": []}, [("_live", T.BooleanType())], **options)
    return flagged.where(F.col("_live")).drop("_live")
