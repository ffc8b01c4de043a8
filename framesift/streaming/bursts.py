"""Bursts over a stream of photos, by time and likeness.

State is split by stretches of time, so a project with most of the photos is as many keys as it has stretches. A photo
goes to its own stretch and, if it was taken within a window's length of the next one, there as well: by it the first
photo of the next stretch is judged. A stretch is given out once the watermark has passed its end; a run that goes on
from the stretch before has no first photo in its own, and ``linked`` says which one it is from a summary of stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from framesift.schema import WINDOW_MS

#: Length of a stretch: state is held for one, and what is given out is late by one at most. Any length above the window gives the same runs.
STRETCH_MS = 60_000
#: The store that state of this kind needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_HELD = ["captured_at", "relative_path", "id", "d_hash"]
_OUT = "project_id string, stretch bigint, island string, id string, captured_at bigint, relative_path string"


def _apart(a: str, b: str) -> int:
    try:
        return (int(a, 16) ^ int(b, 16)).bit_count()
    except (TypeError, ValueError):
        return 64


class Stretches(StatefulProcessor):
    """Holds the photos of a stretch, in a list that only grows, until its time has passed."""

    def __init__(self, threshold: int, stretch_ms: int):
        self.threshold, self.stretch_ms = threshold, stretch_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "captured_at bigint, relative_path string, id string, d_hash string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        self.handle.registerTimer((key[1] + 1) * self.stretch_ms)
        for frame in rows:
            self.held.appendList(list(frame[_HELD].itertuples(index=False, name=None)))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows, begin, out = sorted(self.held.get(), key=lambda r: r[:3]), key[1] * self.stretch_ms, []
        last, island = None, None
        for at, path, photo, bits in rows:
            if at >= begin:
                if last is None or at - last[0] > WINDOW_MS or _apart(last[1], bits) > self.threshold:
                    island = photo
                out.append((key[0], key[1], island, photo, at, path))
            last = at, bits
        self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=["project_id", "stretch", "island", "id", "captured_at", "relative_path"])


def stream_bursts(photos: DataFrame, threshold: int, lateness: str = "1 minute", stretch_ms: int = STRETCH_MS) -> DataFrame:
    """project_id, stretch, island, id, captured_at, relative_path of every usable photo of a stream, once its stretch has passed.

    Photos may come in any order within ``lateness``; later ones are dropped by the watermark. ``island`` is null where a
    run goes on from the stretch before; ``linked`` fills it in. The session needs ``STATE_STORE``. Pair decisions by
    hand are a matter for the batch form.
    """
    if stretch_ms < WINDOW_MS:
        raise ValueError("a stretch can't be shorter than the window")
    usable = photos.where(~F.col("is_missing") & F.col("captured_at").isNotNull() & F.col("d_hash").isNotNull())
    timed = usable.withColumn("at", F.timestamp_millis("captured_at")).withWatermark("at", lateness)
    own = F.floor(F.col("captured_at") / stretch_ms)
    both = F.when(F.pmod("captured_at", F.lit(stretch_ms)) >= stretch_ms - WINDOW_MS, F.array(own, own + 1)).otherwise(F.array(own))
    rows = timed.select("project_id", F.explode(both).alias("stretch"), *_HELD, "at")
    return rows.groupBy("project_id", "stretch").transformWithStateInPandas(Stretches(threshold, stretch_ms), _OUT, "Append", "EventTime")


def linked(parts: DataFrame) -> DataFrame:
    """project_id, island, id, captured_at, relative_path: what ``stream_bursts`` gave out, each run under its first photo.

    Only the last run of each stretch passes on to others, so they are linked by a row a stretch.
    """
    place = F.struct("captured_at", "relative_path", "id")
    lasts = parts.where(F.col("island").isNotNull()).groupBy("project_id", "stretch").agg(F.max_by("island", place).alias("last"))
    every = parts.groupBy("project_id", "stretch").agg(F.count("*").alias("n")).join(lasts, ["project_id", "stretch"], "left")
    earlier = Window.partitionBy("project_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = every.select("project_id", "stretch", F.last("last", ignorenulls=True).over(earlier).alias("before"))
    return parts.join(before, ["project_id", "stretch"]).select("project_id", F.coalesce("island", "before").alias("island"), "id", "captured_at", "relative_path")


def time_bursts(photos: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Runs of photos of a stream by time alone: project_id, first and last time, and number."""
    timed = photos.where(~F.col("is_missing") & F.col("captured_at").isNotNull()).withColumn("at", F.timestamp_millis("captured_at")).withWatermark("at", lateness)
    counted = timed.groupBy("project_id", F.session_window("at", f"{WINDOW_MS} milliseconds")).agg(F.count("*").alias("n"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"))
    return counted.select("project_id", "first_at", "last_at", "n")
