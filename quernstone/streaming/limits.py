"""Structured Streaming forms of the limiter, the circuit breaker, the running budget and the event store.

The batch queries answer the same questions over a finished table; these run on an endless one.
Watermarks bound what state is kept and how late a row may be.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernstone.plans import ship

# Failures in a row that open a breaker, and the wait before it is tried again.
FAILURES_TO_OPEN, COOL_DOWN_US = 3, 60_000_000


def requests_per_window(events: DataFrame, key: str, ts: str, length: str = "60 seconds", slide: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """Requests of each key in sliding windows: (window, key, n)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, slide), key).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap: (session_window, key, n)."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))


def once(events: DataFrame, row_id: str, ts: str, late: str = "1 day") -> DataFrame:
    """Events without redelivered copies, whose ids are forgotten after ``late``."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([row_id])


def breaker_step(state: str, streak: int, last_failure: int, at: int, failed: bool) -> tuple[str, int, int]:
    """State, failures in a row and time of the last failure after one request.

    closed opens at the third failure in a row; open turns half-open at the next request 60
    seconds after the last failure; half-open closes on success and opens again on failure.
    """
    if state == "open" and at - last_failure >= COOL_DOWN_US:
        state = "half_open"
    if state == "open":
        return state, streak, last_failure
    if not failed:
        return "closed", 0, last_failure
    streak += 1
    return ("open" if state == "half_open" or streak >= FAILURES_TO_OPEN else state), streak, at


def circuit_breaker(events: DataFrame, key: str, row_id: str, ts_us: str, failed: str) -> DataFrame:
    """(key, id, state, streak) after each event; state is kept by key between batches."""
    ship(events.sparkSession)

    def run(k: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state, streak, last = group.get if group.exists else ("closed", 0, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        out = []
        for i, at, bad in zip(rows["id"], rows["at"], rows["failed"], strict=True):
            state, streak, last = breaker_step(state, streak, last, int(at), bool(bad))
            out.append((k[0], i, state, streak))
        group.update((state, streak, last))
        yield pd.DataFrame(out, columns=["key", "id", "state", "streak"])

    src = events.select(F.col(key).cast("string").alias("key"), F.col(row_id).cast("long").alias("id"), F.col(ts_us).cast("long").alias("at"), F.col(failed).alias("failed"))
    return src.groupBy("key").applyInPandasWithState(run, "key string, id bigint, state string, streak int", "state string, streak int, last bigint", "append", GroupStateTimeout.NoTimeout)


def running_budget(events: DataFrame, key: str, amount: str, cap: float) -> DataFrame:
    """(key, spent, exceeded) so far; only more than the cap exceeds it. For update or complete mode."""
    return events.groupBy(key).agg(F.sum(F.col(amount).cast("decimal(18,2)")).alias("spent")).withColumn("exceeded", F.col("spent") > cap)


def fan_out(events: DataFrame, row_id: str, state: str) -> DataFrame:
    """One row for each key of an event's state delta, a JSON object."""
    return events.select(row_id, F.explode(F.from_json(state, "map<string,string>")).alias("key", "value"))
