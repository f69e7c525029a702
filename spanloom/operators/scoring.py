"""Scores to per-frame tags: an Arrow scorer, thresholds, category routing, image rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .sizes import small


def linear_head(weights: list[float], bias: float = 0.0):
    """O-41, O-42: sigmoid(w . x + b) over Arrow batches; the batch size is Spark's, so nothing is padded."""
    w = np.array(weights)

    @F.arrow_udf("double")
    def head(vectors: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in vectors:
            lists = v.cast(pa.list_(pa.float64()))
            flat, length = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            if len(lists) and (lists.null_count or not np.all(length == len(w))):
                score = [None if x is None or len(x) != len(w) else 1 / (1 + np.exp(-(np.dot(x, w) + bias))) for x in lists.to_pylist()]
                yield pa.array(score, pa.float64())
            else:
                yield pa.array(1 / (1 + np.exp(-(flat.reshape(-1, len(w)) @ w + bias))))

    return head


@dataclass
class Head:
    """O-41: a model as tasks need it: a batch of vectors (n x dims) to scores (n x tags), its tags and their categories.

    categories: one for each tag index, None for indexes that go nowhere.  scores is sent to the tasks with the code; a session of an
    inference library may be opened inside it, once a worker.
    """

    name: str
    scores: Callable[[np.ndarray], np.ndarray]
    tags: list[str]
    categories: list[str | None]
    dims: int
    threshold: float | None = 0.5


def linear_scores(weights: np.ndarray, bias: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """sigmoid(X W + b) for W of tags x dims."""
    w, b = np.asarray(weights, float), np.asarray(bias, float)
    return lambda x: 1 / (1 + np.exp(-(x @ w.T + b)))


def score_all(frames: DataFrame, heads: list[Head], threshold: float | None = None, skip: tuple[str, ...] = (), vector: str = "frame", stats: Observation | None = None) -> DataFrame:
    """O-41 to O-44, O-48, O-66, O-67, O-72 in one pass over the frames, however many models there are.

    (media_id, frame_index, vector) to (media_id, category, tag, frame_index, confidence, model).  A batch is scored by every head
    and only tags above the threshold leave the task, so scores are never exploded.  threshold, or a head's own where it is 0 or None, is strict; with
    neither every mapped tag is kept.  Heads whose categories are all on the skip list don't run.  Vectors that are null, hold
    nulls, or have another length than a head's dims have no tags of it.  Confidence is rounded to two decimals, half to even.

    stats: an Observation that gets the pass's own metrics (O-80): vectors scored, tags that passed, and models that ran.
    """
    used = [h for h in heads if any(c is not None and c not in skip for c in h.categories)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("x")
            lengths = np.asarray(column.value_lengths().fill_null(-1))
            whole = lengths >= 0
            flat = column.flatten()
            if flat.null_count:  # a vector with a null has no score
                ends = np.cumsum(np.maximum(lengths, 0))
                holes = np.r_[0, np.cumsum(np.asarray(flat.is_null()))]
                whole &= holes[ends] == holes[ends - np.maximum(lengths, 0)]
            values, starts = flat.to_numpy(zero_copy_only=False).astype(float), np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
            for h in used:
                at = np.flatnonzero(whole & (lengths == h.dims))
                if not len(at):
                    continue
                scores = np.asarray(h.scores(values[starts[at][:, None] + np.arange(h.dims)]), float)
                limit = threshold or h.threshold
                passed = scores > limit if limit else np.ones(scores.shape, bool)
                passed &= np.array([c is not None for c in h.categories])
                row, idx = np.nonzero(passed)
                if len(row):
                    names = [pa.array(x, pa.string()).take(pa.array(idx)) for x in (h.categories, h.tags)]
                    keys = [b.column(n).take(pa.array(at[row])) for n in ("media_id", "frame_index")]
                    yield pa.RecordBatch.from_arrays([keys[0], *names, keys[1], pa.array(scores[row, idx]), pa.array([h.name] * len(row))], ["media_id", "category", "tag", "frame_index", "score", "model"])

    rows = frames.select("media_id", "frame_index", F.col(vector).cast("array<double>").alias("x"))
    if stats is not None:
        rows = rows.observe(stats, F.count("*").alias("frames"), F.lit(len(used)).alias("models"))
    kinds = dict(frames.dtypes)
    found = rows.mapInArrow(run, f"media_id {kinds['media_id']}, category string, tag string, frame_index {kinds['frame_index']}, score double, model string")
    return found.select("media_id", "category", "tag", "frame_index", F.bround("score", 2).alias("confidence"), "model")


def threshold_tags(scores: DataFrame, tags: DataFrame, threshold: float | None, default: float | None = None) -> DataFrame:
    """O-43, O-66: scores(media_id, frame_index, model, scores) to tags above the threshold (strict), by posexplode.

    A threshold of 0 or None is the model's default; with neither, every tag is kept.  Confidence is rounded to
    two decimals, half to even, after the test.
    """
    limit = threshold or default
    rows = scores.select("media_id", "frame_index", "model", F.posexplode("scores").alias("idx", "score"))
    if limit:
        rows = rows.where(F.col("score") > limit)
    named = rows.join(small(tags), ["model", "idx"])
    return named.select("media_id", "frame_index", "model", "idx", F.col("name").alias("tag"), F.bround(F.col("score").cast("double"), 2).alias("confidence"))


def route(tagged: DataFrame, mappings: DataFrame) -> DataFrame:
    """O-44, O-67: each tag index to its category; unmapped indexes go."""
    return tagged.join(small(mappings), ["model", "idx"]).select("media_id", "category", "tag", "frame_index", "confidence")


def image_rules(tagged: DataFrame, rules: DataFrame, use_thresholds: bool) -> DataFrame:
    """O-45: configured tags only, shown by their display name; with thresholds on, at or above the tag's."""
    rows = tagged.join(small(rules), ["category", "tag"])
    if use_thresholds:
        rows = rows.where("confidence is null or confidence >= tag_threshold")
    return rows.select("media_id", "category", F.col("display").alias("tag"), "confidence")


def image_passthrough(tags: Column) -> Column:
    """O-46: no tags for null."""
    return F.coalesce(tags, F.array().cast("array<string>"))


def skipped(categories: Column, skip: Column) -> Column:
    """O-48: a model is skipped if all its categories are on the skip list."""
    return F.size(F.array_except(categories, skip)) == 0


def combine_models(*parts: DataFrame) -> DataFrame:
    """O-72, O-97: the outputs of several models for the same frames, in long form; what was skipped has no rows."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def await_frames(detections: DataFrame) -> DataFrame:
    """O-73: a media's frames as one row: how many frames and detections there are."""
    return detections.groupBy("media_id").agg(F.count_distinct("frame_index").alias("frames"), F.count("*").alias("detections"))
