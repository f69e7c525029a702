"""Runs of detections from a stream: session windows where confidence is not compared, keyed state where it is."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEY = ["media_id", "category", "tag"]


class Gauge(StreamingQueryListener):
    """O-109: batches begun and ended, input rows and the rows still waiting, of the streaming queries of a session.

    ``spark.streams.addListener(gauge)``; waiting is the last batch's backlog where the source reports one.
    """

    def __init__(self):
        self.running: set[str] = set()
        self.batches = self.rows = self.waiting = 0

    def onQueryStarted(self, event) -> None:
        self.running.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches += 1
        self.rows += p.numInputRows
        self.waiting = sum(int((s.metrics or {}).get("numFilesOutstanding", (s.metrics or {}).get("maxOffsetsBehindLatest", 0)) or 0) for s in p.sources)

    def onQueryIdle(self, event) -> None:
        self.waiting = 0

    def onQueryTerminated(self, event) -> None:
        self.running.discard(str(event.runId))


def bounded_stream(spark: SparkSession, path: str, schema: str, most_files: int, kind: str = "parquet") -> DataFrame:
    """O-106: a file stream whose batches take at most ``most_files`` new files, so a backlog waits in the source."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).format(kind).load(path)


def batched_writer(stream: DataFrame, handle, checkpoint: str, wait: str | None = None):
    """O-105: ``handle(batch, number)`` of each micro-batch, begun every ``wait``; with None, of all there is, then the end."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=wait) if wait else writer.trigger(availableNow=True)


def stream_runs(detections: DataFrame, interval: int, max_merge: int, delay: str) -> DataFrame:
    """O-51 without confidence: detections(media_id, category, tag, ts) to closed runs.

    A session merges what comes exactly the gap later, as the rule's "at most" does; its end is the last detection,
    and null for one alone.  Rows later than ``delay`` behind the watermark are dropped by Spark and counted in
    the query's progress.
    """
    gap = f"{interval + max_merge} seconds"
    runs = detections.withWatermark("ts", delay).groupBy(*KEY, F.session_window("ts", gap)).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return runs.select(*KEY, "start", F.when(F.col("last") > F.col("start"), F.col("last")).alias("end"))


def stream_runs_by_confidence(detections: DataFrame, interval: int, max_merge: int, delay: str) -> DataFrame:
    """O-51 with confidence: a key's state is its open run and the detections that may still be overtaken.

    Detections are put in order once the watermark has passed them; a run closes when a detection does not extend
    it, or when the watermark passes its end by the gap.  State is bounded by the detections within ``delay``.
    """
    gap = pd.Timedelta(seconds=interval + max_merge)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, start, last, confidence = state.get if state.exists else ([], None, None, None)
        rows = [(t, c) for t, c in waiting]
        for b in batches:
            rows += [(t.value // 1000, None if pd.isna(c) else float(c)) for t, c in zip(b["ts"], b["confidence"])]
        rows.sort(key=lambda r: r[0])
        mark = state.getCurrentWatermarkMs() * 1000
        out, step = [], int(gap.value // 1000)
        while rows and rows[0][0] <= mark:
            t, c = rows.pop(0)
            if start is not None and t == last:
                continue  # a repeated frame
            if start is None or t - last > step or c != confidence:
                if start is not None:
                    out.append((start, last, confidence))
                start, confidence = t, c
            last = t
        if start is not None and last + step < mark:
            out.append((start, last, confidence))
            start = last = confidence = None
        if rows or start is not None:
            state.update((rows, start, last, confidence))
            wake = min([r[0] for r in rows] + ([last + step] if last is not None else []))
            state.setTimeoutTimestamp(max(wake // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            time = lambda i, alone=False: None if alone else pd.Timestamp(i, unit="us")
            yield pd.DataFrame({
                **{k: [v] * len(out) for k, v in zip(KEY, key)},
                "start": [time(a) for a, _, _ in out], "end": pd.to_datetime([time(b, a == b) for a, b, _ in out]), "confidence": pd.array([c for _, _, c in out], "Float64").to_numpy(float, na_value=float("nan")),
            })

    types = dict(detections.dtypes)
    output = ", ".join(f"{k} {types[k]}" for k in KEY) + ", start timestamp, end timestamp, confidence double"
    held = "waiting array<struct<t: long, c: double>>, start long, last long, confidence double"
    return detections.withWatermark("ts", delay).groupBy(*KEY).applyInPandasWithState(update, output, held, "append", GroupStateTimeout.EventTimeTimeout)
