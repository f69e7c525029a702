"""The service's requests as functions from DataFrames to DataFrames: one call serves any number of media."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import overlap as O
from ..operators import results as R
from ..operators.scoring import image_rules
from ..operators.segments import merge_buckets_segmented, merge_proportional_streamed
from ..operators.sizes import small
from .dag import Model, Pipeline, Registry, score_frames


@dataclass
class MediaTags:
    """D16, O-63: markers, totals and assigned tags; spans and model rows are what is stored."""

    spans: DataFrame
    models: DataFrame
    markers: DataFrame
    totals: DataFrame
    tags: DataFrame


#: O-62: marker methods by name, with their default parameters.
METHODS = {
    "gap": lambda spans, interval, **_: I.merge_gaps(spans, F.lit(interval)),
    "cluster": lambda spans, interval, **p: _clustered(spans, interval, p),
    "proportional": lambda spans, interval, proportion=0.5, **_: merge_proportional_streamed(spans, str(interval), proportion),
}
ACTIVE = "cluster"


def _clustered(spans: DataFrame, interval: float, params: dict) -> DataFrame:
    buckets = I.adjacency_buckets(spans, F.lit(interval))
    least = spans.select(*I.KEY, "min_marker_duration").distinct()
    merged = merge_buckets_segmented(buckets, params=params).join(least, I.KEY)
    return I.keep_long(merged, F.col("min_marker_duration")).drop("min_marker_duration")


def tag_info(spans: DataFrame, models: DataFrame, rules: DataFrame, media: DataFrame, interval: float, method: str = ACTIVE, **params) -> MediaTags:
    """O-63, O-104: all that is derived from stored spans, without scoring anything."""
    if method not in METHODS:
        raise ValueError(f"no method is called {method!r}: {sorted(METHODS)}")
    sums = I.totals(spans, rules, F.lit(interval), media)
    return MediaTags(spans, models, METHODS[method](I.with_rules(spans, rules), interval, **params), sums, I.assigned_tags(sums))


def _model_rows(media: DataFrame, models: list[Model], interval: float, threshold: float | None) -> DataFrame:
    rows = [(m.name, m.identifier, float(m.version), c, float(threshold or m.threshold)) for m in models for c in m.categories]
    kinds = "file_name string, ai_model_id int, version double, category string, threshold double"
    table = media.sparkSession.createDataFrame(rows, kinds)
    return media.select("media_id").join(F.broadcast(table)).select("media_id", "category", F.lit(float(interval)).alias("frame_interval"), "threshold", "version", "ai_model_id", "file_name")


def process_media(
    frames: DataFrame, media: DataFrame, models: list[Model], rules: DataFrame, *, interval: float = 2.0, threshold: float | None = None,
    existing: DataFrame | None = None, rerun_better: bool = False, method: str = ACTIVE,
) -> MediaTags:
    """POST process_video: score what no stored result covers, merge it in, derive markers and tags.

    existing: (media_id, json) in the V1 format.  Frames are scored only for media with work, and the categories
    a media need not run again are left out of its detections.
    """
    active = _model_rows(media, models, interval, threshold)
    if existing is None:
        found = score_frames(frames, models, threshold, [], True)
        spans, rows = R.build_v1(found, active, F.lit(interval))
        return tag_info(spans, rows, rules, media, interval, method)
    old_spans, old_models = R.spans_of_v1(existing), R.models_of_v1(existing)
    plan = R.plan_reuse(active, old_models, rerun_better)
    work = plan.where("work").select("media_id", "category")
    found = score_frames(frames.join(work.select("media_id").distinct(), "media_id", "left_semi"), models, threshold, [], True)
    new_spans = I.run_lengths(found.join(work, ["media_id", "category"], "left_semi"), F.lit(interval))
    spans = R.upsert(old_spans, new_spans, work)
    rows = R.upsert(old_models, active, work)
    return tag_info(spans, rows, rules, media, interval, method)


def process_media_v3(frames: DataFrame, media: DataFrame, models: list[Model], *, interval: float = 2.0, threshold: float | None = None, skip: list[str] | None = None, max_merge: float = 4.0) -> DataFrame:
    """POST v3 process_video: (media_id, json) without confidence or rules; models wholly on the skip list do not run."""
    used = [m for m in models if not set(m.categories) <= set(skip or [])]
    found = score_frames(frames, used, threshold, [], False)
    rows = [(m.name, m.identifier, float(m.version), m.categories, m.type) for m in used]
    table = media.sparkSession.createDataFrame(rows, "name string, identifier int, version double, categories array<string>, type string")
    return R.build_v3(found, media.select("media_id").join(F.broadcast(table)), media, interval, max_merge)


def process_images(frames: DataFrame, models: list[Model], rules: DataFrame | None, *, threshold: float | None = None, with_confidence: bool = False, use_thresholds: bool = False) -> DataFrame:
    """POST process_images (with rules) and its v3 (rules None): tags of every picture, in long form."""
    found = score_frames(frames, models, threshold, [], with_confidence)
    if rules is None:
        return found.select("media_id", "category", "tag", "confidence")
    return image_rules(found, rules, use_thresholds)


def optimise_markers(existing: DataFrame, wanted: DataFrame, rules: DataFrame, grid: DataFrame, *, interval: float, least: float) -> DataFrame:
    """POST optimize_timeframe_settings: the ten best parameter rows for stored spans and hand-made intervals."""
    spans = R.spans_of_v1(existing)
    shown = rules.select("category", "tag", "display")
    desired = O.desired_lookup(wanted, rules).withColumnRenamed("tag", "display").join(small(shown), ["category", "display"]).drop("display")
    buckets = I.adjacency_buckets(I.with_rules(spans, rules), F.lit(interval))
    return O.grid_search(buckets, O.coalesced(desired.select(*I.KEY, "start", "end")), grid, least)


def current_models(registry: Registry, name: str) -> list[dict]:
    """GET current_ai_models."""
    return registry.get(name).model_rows()


def health(registry: Registry) -> dict:
    """GET health, O-84."""
    each = {n: len(registry.get(n).models) for n in registry.names()}
    return {"pipelines": each, "models": sum(each.values())}


def ready(registry: Registry) -> bool:
    """GET ready: whether any pipeline has been added."""
    return bool(registry.names())


__all__ = [
    "METHODS", "MediaTags", "Pipeline", "current_models", "health", "optimise_markers", "process_images", "process_media",
    "process_media_v3", "ready", "tag_info",
]
