"""The circuit breaker in event time: events wait in state until the watermark has passed them.

Rows may come in any order of files, as long as none is later than the watermark allows. A key's
events wait in list state, those of a micro-batch packed in one entry, since state is reached by a
call for each entry; one event-time timer wakes the key when the first of them is due, and
what the watermark has passed goes through the breaker in the order of time. State lives in the
session's state store provider, which must be RocksDB, and outlives restarts by the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quernstone.plans import ship
from quernstone.streaming.limits import breaker_step

#: The provider that keeps list state and timers.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = ["key", "id", "state", "streak"]
#: An event as it waits.
_EVENT = np.dtype([("at", "<i8"), ("id", "<i8"), ("failed", "?")])


def _packed(part: pd.DataFrame) -> np.ndarray:
    """Rows as they wait."""
    out = np.empty(len(part), _EVENT)
    for name in _EVENT.names:
        out[name] = part[name].to_numpy()
    return out


def _due_at(us):
    """The watermark in milliseconds from which on an event's time has passed."""
    return us // 1000 + 1


class EventTimeBreaker(StatefulProcessor):
    """One breaker for each key."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.breaker = handle.getValueState("breaker", "state string, streak int, last bigint")
        self.wake = handle.getValueState("wake", "at bigint")

    def _woken(self) -> int | None:
        """When the timer is due, if there is one."""
        old = self.wake.get()
        return None if old is None else old[0]

    def _wake_at(self, at: int | None) -> None:
        """Keep one timer, for ``at``."""
        old = self._woken()
        if old == at:
            return
        if old is not None:
            self.handle.deleteTimer(old)
            self.wake.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.wake.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [_packed(part) for part in rows]
        first = min((int(e["at"].min()) for e in new if len(e)), default=None)
        if first is not None:
            self.waiting.appendValue((np.concatenate(new).tobytes(),))
            # a time that has passed already is due with the next watermark
            first = max(_due_at(first), timerValues.getCurrentWatermarkInMs() + 1)
            old = self._woken()
            if old is None or first < old:
                self._wake_at(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._woken() == expiredTimerInfo.getExpiryTimeInMs():
            self.wake.clear()
        passed = timerValues.getCurrentWatermarkInMs()
        parts = [np.frombuffer(e, _EVENT) for (e,) in self.waiting.get()]
        events = np.concatenate(parts) if parts else np.empty(0, _EVENT)
        events = events[np.lexsort((events["failed"], events["id"], events["at"]))]
        n = int(np.count_nonzero(_due_at(events["at"]) <= passed))
        due, rest = events[:n].tolist(), events[n:]
        state, streak, last = self.breaker.get() or ("closed", 0, 0)
        out = []
        for at, i, failed in due:
            state, streak, last = breaker_step(state, streak, last, at, failed)
            out.append((key[0], i, state, streak))
        if due:
            self.breaker.update((state, streak, last))
        if len(rest):
            self.waiting.put([(rest.tobytes(),)])
            self._wake_at(_due_at(int(rest["at"][0])))
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=_OUT)

    def close(self) -> None:
        pass


def event_time_breaker(events: DataFrame, key: str, row_id: str, ts: str, failed: str, late: str = "10 minutes") -> DataFrame:
    """(key, id, state, streak) after each event, once no earlier event of its key can come any more.

    Events of one time go by id. Rows without a time, key or id have no place in the order and are
    left out; a null ``failed`` is no failure. Events later than ``late`` are dropped.
    """
    ship(events.sparkSession)
    src = events.select(F.col(key).cast("string").alias("key"), F.col(row_id).cast("long").alias("id"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("at"), F.coalesce(F.col(failed), F.lit(False)).alias("failed"))
    src = src.where("key is not null and id is not null and at is not null").withWatermark("ts", late)
    return src.groupBy("key").transformWithStateInPandas(EventTimeBreaker(), "key string, id bigint, state string, streak int", "append", "eventTime")
