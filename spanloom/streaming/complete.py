"""O-72, O-73: waiting for a media's frames in a stream: emitted once when every expected output has come, or with its gaps at a timeout.

An announcement says how many frames a media has and which models run on it; outputs say that a model has finished a
frame.  They may come in any order, late within the watermark's delay, and more than once.  What is expected but does not
come until ``timeout`` of event time after the media's last arrival is reported as missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESULT = "media_id long, expected long, received long, missing long, first_gap long, complete boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrivals(outputs: DataFrame, media: DataFrame) -> DataFrame:
    """outputs(media_id, frame, model, ts) and media(media_id, frames, models, ts) as rows of one stream."""
    none = lambda kind: F.lit(None).cast(kind)
    got = outputs.select("media_id", "ts", F.col("frame").cast("long").alias("frame"), "model", none("long").alias("frames"), none("array<string>").alias("models"))
    told = media.select("media_id", "ts", none("long").alias("frame"), none("string").alias("model"), F.col("frames").cast("long").alias("frames"), F.col("models").cast("array<string>").alias("models"))
    return got.unionAll(told)


def complete_media(outputs: DataFrame, media: DataFrame) -> DataFrame:
    """The same over whole tables: expected, received and missing outputs of every media, and its first frame with a gap.

    A media that is announced more than once counts as first announced (by ts, then the smaller values); one that never is has a null
    expectation and is not complete.  Outputs that are not expected, and rows without frame or model, do not count.
    """
    first = media.groupBy("media_id").agg(F.min(F.struct("ts", F.col("frames").cast("long").alias("frames"), F.array_distinct("models").alias("models"))).alias("m"))
    told = first.select("media_id", F.lit(True).alias("told"), "m.frames", "m.models")
    got = outputs.select("media_id", F.col("frame").cast("long").alias("frame"), "model").distinct()
    rows = got.join(told, "media_id", "full")
    fits = F.col("told") & F.array_contains("models", F.col("model")) & (F.col("frame") >= 0) & (F.col("frame") < F.col("frames"))
    # frames are counted first, so that a long media is aggregated by frame before it is one row
    each = rows.groupBy("media_id", "frame").agg(F.max("told").alias("told"), F.max("frames").alias("frames"), F.max(F.size("models")).alias("wanted"), F.count_if(fits).alias("n"))
    full = F.when((F.col("n") > 0) & (F.col("n") == F.col("wanted")), F.col("frame"))
    gap = F.when((F.col("n") > 0) & (F.col("n") < F.col("wanted")), F.col("frame"))
    out = each.groupBy("media_id").agg(F.max("told").alias("told"), (F.max("frames") * F.max("wanted")).alias("expected"), F.sum("n").alias("received"), F.min(gap).alias("gap"), F.max("frames").alias("frames"))
    seen = each.where("n > 0").select("media_id", "frame").join(out.where("received < expected").select("media_id"), "media_id")
    from pyspark.sql import Window

    w = Window.partitionBy("media_id").orderBy("frame")
    hole = seen.withColumn("next", F.coalesce(F.lag("frame").over(w), F.lit(-1)) + 1).where("next < frame").groupBy("media_id").agg(F.min("next").alias("hole"))
    last = each.where(full.isNotNull() | gap.isNotNull()).groupBy("media_id").agg((F.max("frame") + 1).alias("after"))
    out = out.join(hole, "media_id", "left").join(last, "media_id", "left")
    first_gap = F.least(F.col("gap"), F.col("hole"), F.when(F.coalesce("after", F.lit(0)) < F.col("frames"), F.coalesce("after", F.lit(0))))
    expected = F.when(F.col("told"), F.col("expected"))
    missing = expected - F.col("received")
    return out.select("media_id", expected.alias("expected"), "received", missing.alias("missing"), F.when(missing > 0, first_gap).alias("first_gap"), F.coalesce(missing == 0, F.lit(False)).alias("complete"))


class _Completeness(StatefulProcessor):
    """Per media: what is expected, the outputs that have come, and a timer at the last arrival plus the timeout."""

    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "frames long, models array<string>")
        self.progress = handle.getValueState("progress", "received long, timer long, done boolean")
        self.came = handle.getMapState("came", "frame long, model string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        received, timer, done = self.progress.get() if self.progress.exists() else (0, 0, False)
        new, announced, last = set(), [], 0
        for batch in rows:
            last = max(last, int(batch["ts"].max().value // 1_000_000))
            for frame, model, frames, models in zip(batch["frame"], batch["model"], batch["frames"], batch["models"]):
                if models is not None:
                    announced.append((int(frames), sorted(set(models))))
                elif frame is not None and not pd.isna(frame) and model is not None:
                    new.add((int(frame), model))
        if not done:
            if announced and not self.told.exists():
                frames, models = min(announced)
                self.told.update((frames, models))
                received = sum(self._fits(k, frames, models) for k in self.came.keys())
            told = self.told.get() if self.told.exists() else None
            for k in new:
                if not self.came.containsKey(k):
                    self.came.updateValue(k, (1,))
                    received += told is not None and self._fits(k, *told)
            if told is not None and received == told[0] * len(told[1]):
                done = True
                self.came.clear()
                yield self._row(key, told, received, None)
        wake = max(timer, last + self.timeout, timerValues.getCurrentWatermarkInMs() + 1)
        if wake != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wake)
        self.progress.update((received, wake, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        received, _, done = self.progress.get()
        if not done:
            told = self.told.get() if self.told.exists() else None
            gap = None
            if told is not None:
                there = {k for k in self.came.keys() if self._fits(k, *told)}
                gap = next((f for f in range(told[0]) if any((f, m) not in there for m in told[1])), None)
            yield self._row(key, told, received, gap)
        for state in (self.told, self.progress, self.came):
            state.clear()

    @staticmethod
    def _fits(k: tuple, frames: int, models: list[str]) -> bool:
        return 0 <= k[0] < frames and k[1] in models

    @staticmethod
    def _row(key, told, received: int, gap: int | None) -> pd.DataFrame:
        expected = None if told is None else told[0] * len(told[1])
        whole = lambda v: pd.array([v], "Int64")
        missing = None if expected is None else expected - received
        return pd.DataFrame({"media_id": [key[0]], "expected": whole(expected), "received": whole(received), "missing": whole(missing), "first_gap": whole(gap), "complete": [missing == 0]})

    def close(self) -> None:
        pass


def stream_complete_media(outputs: DataFrame, media: DataFrame, delay: str, timeout_seconds: int) -> DataFrame:
    """A row of ``RESULT`` for each media, once: when it is complete, or ``timeout_seconds`` after its last arrival.

    Spark drops arrivals later than ``delay`` behind the watermark.  A media's state is its outputs, at most those
    expected and whatever comes before its announcement; it goes when the timer fires.  What arrives on time after a media was
    emitted changes nothing until then; after it, a media begins anew.  The session's state store must be RocksDB (``PROVIDER``).
    """
    rows = arrivals(outputs, media).withWatermark("ts", delay)
    return rows.groupBy("media_id").transformWithStateInPandas(_Completeness(timeout_seconds * 1000), RESULT, "append", "EventTime")
