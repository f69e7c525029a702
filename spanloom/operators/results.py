"""Stored results: when to reprocess, what to reuse, merging new results in, and older formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import run_lengths
from .sizes import small

#: Identifiers from this one on are early models, whose successors always rerun.
EARLY_MODEL = 950
SPAN = "struct<start: double, end: double, confidence: double>"
MODEL = "struct<frame_interval: double, threshold: double, version: double, ai_model_id: int, file_name: string>"
V1 = f"schema_version int, metadata struct<duration: double, models: map<string, {MODEL}>>, timespans map<string, map<string, array<{SPAN}>>>"
V0 = (
    "video_metadata struct<video_id: bigint, duration: double, phash: string, models: map<string, struct<version: double, "
    f"ai_model_config: struct<frame_interval: double, threshold: double>>>>, tags map<string, struct<ai_model_name: string, time_frames: array<{SPAN}>>>"
)
V3 = (
    "schema_version int, duration double, models array<struct<name: string, identifier: int, version: double, categories: array<string>, "
    f"type: string>>, frame_interval double, timespans map<string, map<string, array<{SPAN}>>>"
)


def needs_reprocessing(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """O-98: 0 as good as stored, 1 a better model of the same version, 2 another model or finer settings.

    Both have frame_interval, threshold, version, ai_model_id and file_name.
    """
    same = new["version"] == old["version"]
    lower = same & (new["ai_model_id"] < old["ai_model_id"])
    model = (
        F.when((new["file_name"] == old["file_name"]) & same, 0)
        .when(lower & (old["ai_model_id"] >= EARLY_MODEL), 2)
        .when(lower, 1)
        .when(same, 0)
        .otherwise(2)
    )
    changed = (new["frame_interval"] % old["frame_interval"] != 0) | (new["threshold"] < old["threshold"])
    return F.when(F.coalesce(changed, F.lit(True)), 2).otherwise(model)


def plan_reuse(active: DataFrame, stored: DataFrame, rerun_better: bool = False) -> DataFrame:
    """O-68, O-99: for each media and category of an active model whether it is work or may be skipped.

    active: media_id, category, frame_interval, threshold, version, ai_model_id, file_name; stored: the same.
    """
    names = ["frame_interval", "threshold", "version", "ai_model_id", "file_name"]
    old = stored.select("media_id", "category", *[F.col(n).alias(f"old_{n}") for n in names], F.lit(True).alias("known"))
    rows = active.join(old, ["media_id", "category"], "left")
    need = needs_reprocessing({n: F.col(f"old_{n}") for n in names}, {n: F.col(n) for n in names})
    work = F.col("known").isNull() | (need == 2) | (F.lit(rerun_better) & (need == 1))
    return rows.select("media_id", "category", F.when(F.col("known").isNotNull(), need).alias("need"), work.alias("work"))


def work_by_media(plan: DataFrame) -> DataFrame:
    """O-99, O-104: whether anything runs for a media, and how many categories are skipped."""
    return plan.groupBy("media_id").agg(F.bool_or("work").alias("work"), F.count_if(~F.col("work")).alias("skipped"))


def skip_lists(plan: DataFrame) -> DataFrame:
    """O-99: each media's skip list, sorted; bounded by the number of categories."""
    return plan.where("not work").groupBy("media_id").agg(F.sort_array(F.collect_set("category")).alias("skip"))


def overlapping_categories(models: DataFrame) -> DataFrame:
    """O-85: categories that more than one of a media's models claim; a result with any must not be built."""
    return models.groupBy("media_id", "category").agg(F.count("*").alias("models")).where("models > 1")


def checked_models(models: DataFrame) -> DataFrame:
    """``models`` whose evaluation fails with the category's name where two models claim it (O-85, O-100)."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("media_id", "category"))
    message = F.concat(F.lit("category claimed by two models: "), F.col("category"))
    return models.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(True)).drop("_n")


def build_v1(detections: DataFrame, models: DataFrame, interval: Column) -> tuple[DataFrame, DataFrame]:
    """O-100: spans and checked model rows of a new result."""
    return run_lengths(detections, interval), checked_models(models)


def build_v3(detections: DataFrame, models: DataFrame, media: DataFrame, interval: float, max_merge: float = 4.0) -> DataFrame:
    """O-102: one JSON text a media: duration, models, interval, spans without confidence.

    A media's spans are one text, as the format asks; their number is bounded by its frames times the tags.
    """
    spans = run_lengths(detections.withColumn("confidence", F.lit(None).cast("double")), F.lit(interval), max_merge)
    return to_json_v3(spans, models, media, interval)


def _by_category(entries: Column) -> Column:
    """Entries in category order; maps cannot be compared, so the order is given."""
    return F.array_sort(entries, lambda a, b: F.when(a["category"] < b["category"], -1).when(a["category"] > b["category"], 1).otherwise(0))


def _span_maps(spans: DataFrame) -> DataFrame:
    each = spans.groupBy("media_id", "category", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "end", "confidence"))).alias("v"))
    each = each.groupBy("media_id", "category").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag", "v")))).alias("v"))
    return each.groupBy("media_id").agg(F.map_from_entries(_by_category(F.collect_list(F.struct("category", "v")))).alias("timespans"))


def to_json_v3(spans: DataFrame, models: DataFrame, media: DataFrame, interval: float) -> DataFrame:
    """O-19, O-102: nulls are left out of the text."""
    listed = models.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("name", "identifier", "version", "categories", "type"))).alias("models"))
    rows = media.join(listed, "media_id", "left").join(_span_maps(spans), "media_id", "left")
    return rows.select("media_id", F.to_json(F.struct(F.lit(3).alias("schema_version"), "duration", "models", F.lit(float(interval)).alias("frame_interval"), "timespans")).alias("json"))


def to_json_v1(spans: DataFrame, models: DataFrame, media: DataFrame) -> DataFrame:
    """O-19: the V1 text of each media."""
    entry = F.struct("frame_interval", "threshold", "version", "ai_model_id", "file_name")
    listed = models.groupBy("media_id").agg(F.map_from_entries(_by_category(F.collect_list(F.struct("category", entry.alias("v"))))).alias("models"))
    rows = media.join(listed, "media_id", "left").join(_span_maps(spans), "media_id", "left")
    return rows.select("media_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.struct("duration", "models").alias("metadata"), "timespans")).alias("json"))


def json_kind(text: Column) -> Column:
    """O-18: "none", "v0" (to be upgraded and saved), "v1" or "v3"."""
    version = F.get_json_object(text, "$.schema_version")
    return F.when(text.isNull(), "none").when(version.isNull(), "v0").when(version == "3", "v3").otherwise("v1")


def spans_of_v1(stored: DataFrame) -> DataFrame:
    """(media_id, json) of kind v1 or v3 to spans."""
    rows = stored.select("media_id", F.from_json("json", "timespans map<string, map<string, array<" + SPAN + ">>>").alias("r"))
    rows = rows.select("media_id", F.explode("r.timespans").alias("category", "tags")).select("media_id", "category", F.explode("tags").alias("tag", "spans"))
    return rows.select("media_id", "category", "tag", F.inline("spans"))


def models_of_v1(stored: DataFrame) -> DataFrame:
    """(media_id, json) of kind v1 to model rows."""
    rows = stored.select("media_id", F.from_json("json", V1).alias("r"))
    return rows.select("media_id", F.explode("r.metadata.models").alias("category", "m")).select("media_id", "category", "m.*")


def upgrade_v0(stored: DataFrame, tag_categories: DataFrame, model_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-50, O-69: (media_id, json) of kind v0 to spans and model rows.

    tag_categories(tag, category): the last category by name wins, else "Unknown".  model_map(name, old_version
    or null for any, category, version, ai_model_id, file_name): unknown names go.
    """
    rows = stored.select("media_id", F.from_json("json", V0).alias("r"))
    last = tag_categories.groupBy("tag").agg(F.max("category").alias("category"))
    spans = rows.select("media_id", F.explode("r.tags").alias("tag", "t")).select("media_id", "tag", F.inline("t.time_frames"))
    spans = spans.join(small(last), "tag", "left").select("media_id", F.coalesce("category", F.lit("Unknown")).alias("category"), "tag", "start", "end", "confidence")
    old = rows.select("media_id", F.explode("r.video_metadata.models").alias("name", "m")).select("media_id", "name", F.col("m.version").alias("was"), "m.ai_model_config.*")
    exact = model_map.withColumn("specific", F.col("old_version").isNotNull())
    found = old.join(small(exact), (old["name"] == exact["name"]) & (exact["old_version"].isNull() | (exact["old_version"] == old["was"])))
    best = found.groupBy("media_id", "category").agg(F.max_by(F.struct("frame_interval", "threshold", "version", "ai_model_id", "file_name"), F.struct("specific", old["name"])).alias("m"))
    return spans, best.select("media_id", "category", "m.*")


def upsert(stored_spans: DataFrame, new_spans: DataFrame, updated: DataFrame) -> DataFrame:
    """O-101: stored spans of untouched categories and new spans of ``updated(media_id, category)``."""
    kept = stored_spans.join(updated, ["media_id", "category"], "left_anti")
    return kept.unionByName(new_spans.join(updated, ["media_id", "category"], "left_semi"))


def updated_categories(stored: DataFrame, new: DataFrame) -> DataFrame:
    """O-101: categories that are unseen, or whose stored model the new one improves on (ledger Q1: the intent)."""
    return plan_reuse(new, stored, rerun_better=True).where("work").select("media_id", "category")
