"""O-18, O-19, O-50, O-100: stored results of all formats, each text parsed once into a VARIANT that keeps what it does not know.

``parsed`` makes the variant; ``spans`` and ``models`` read any format from it, typed paths at a time; ``rewritten`` puts new
spans and models into the document and leaves every other field as it was.  No filter stands on what is parsed, since a pushed
filter would parse once more: kinds are told apart inside the expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .results import MODEL, SPAN
from .sizes import small

TAGS = f"map<string, array<{SPAN}>>"
LISTED = "array<struct<name: string, identifier: int, version: double, categories: array<string>, type: string>>"
V0_MODELS = "map<string, struct<version: double, ai_model_config: struct<frame_interval: double, threshold: double>>>"

#: The models that results of the oldest format name, the version there (None: any other), and the category,
#: version, identifier and file of the model that each stands for.
LEGACY_MODELS = [
    ("actiondetection", 2.0, "actions", 2.0, 200, "gentler_river"),
    ("actiondetection", None, "actions", 0.1, 950, None),
    ("bodyparts", None, "bodyparts", 0.5, 200, "iconic_sky"),
    ("actiondetection_bodyparts_bdsm", None, "bdsm", 0.7, 200, "true_lake"),
    ("actiondetection_bodyparts_bdsm", None, "actions", 2.0, 200, "gentler_river"),
    ("actiondetection_bodyparts_bdsm", None, "bodyparts", 0.5, 200, "iconic_sky"),
    ("actiondetection_bodyparts", None, "actions", 2.0, 200, "gentler_river"),
    ("actiondetection_bodyparts", None, "bodyparts", 0.5, 200, "iconic_sky"),
]


def legacy_models(spark: SparkSession) -> DataFrame:
    """``LEGACY_MODELS`` as the model_map of ``models``."""
    return spark.createDataFrame(LEGACY_MODELS, "name string, old_version double, category string, version double, ai_model_id int, file_name string")


def parsed(stored: DataFrame) -> DataFrame:
    """(media_id, json) to (media_id, kind, doc): kind is none, damaged, v0, v1 or v3; doc the text as a variant.

    A damaged text, and a document that is no object, has a null doc: it has no spans and models, and ``rewritten`` replaces it.
    """
    doc = F.try_parse_json("json")
    rows = stored.select("media_id", F.col("json").isNull().alias("_none"), doc.alias("doc"))
    known = F.schema_of_variant("doc").startswith("OBJECT")
    version = F.try_variant_get("doc", "$.schema_version", "string")
    kind = F.when(F.col("_none"), "none").when(~F.coalesce(known, F.lit(False)), "damaged").when(version.isNull(), "v0").when(version == "3", "v3").otherwise("v1")
    return rows.select("media_id", kind.alias("kind"), F.when(known, F.col("doc")).alias("doc"))


def _at(path: str, kind: str) -> Column:
    return F.try_variant_get("doc", path, kind)


def spans(docs: DataFrame, tag_categories: DataFrame | None = None) -> DataFrame:
    """Spans of parsed results of any format: media_id, category, tag, start, end, confidence.

    tag_categories(tag, category) gives the categories of the oldest format's tags, the last by name, else "Unknown".
    What is not of its type is null, and a span without a start is left out.
    """
    by_category = F.flatten(F.transform(F.map_entries(_at("$.timespans", f"map<string, {TAGS}>")), lambda c: F.transform(F.map_entries(c["value"]), lambda t: F.struct(c["key"].alias("category"), t["key"].alias("tag"), t["value"].alias("spans")))))
    old = F.transform(F.map_entries(_at("$.tags", f"map<string, struct<time_frames: array<{SPAN}>>>")), lambda t: F.struct(F.lit(None).cast("string").alias("category"), t["key"].alias("tag"), t["value"]["time_frames"].alias("spans")))
    rows = docs.select("media_id", F.explode(F.when(F.col("kind") == "v0", old).otherwise(by_category)).alias("x"))
    rows = rows.select("media_id", "x.category", "x.tag", F.inline("x.spans")).where("start is not null")
    if tag_categories is None:
        return rows.withColumn("category", F.coalesce("category", F.lit("Unknown")))
    last = tag_categories.groupBy("tag").agg(F.max("category").alias("_category"))
    rows = rows.join(small(last), "tag", "left").withColumn("category", F.coalesce("category", "_category", F.lit("Unknown")))
    return rows.select("media_id", "category", "tag", "start", "end", "confidence")


def models(docs: DataFrame, model_map: DataFrame | None = None) -> DataFrame:
    """Model rows of parsed results of the formats v0 and v1: media_id, category, and the fields of a model.

    model_map(name, old_version or null for any other, category, version, ai_model_id, file_name), by default ``legacy_models``,
    says what the oldest format's models stand for; names it does not have go.  Where two stand for one category, one with its
    version named wins, then the last name.
    """
    model_map = legacy_models(docs.sparkSession) if model_map is None else model_map
    named = F.transform(F.map_entries(_at("$.metadata.models", f"map<string, {MODEL}>")), lambda m: F.struct(m["key"].alias("name"), m["value"].alias("new"), F.lit(None).cast(V0_MODELS.removeprefix("map<string, ")[:-1]).alias("old")))
    legacy = F.transform(F.map_entries(_at("$.video_metadata.models", V0_MODELS)), lambda m: F.struct(m["key"].alias("name"), F.lit(None).cast(MODEL).alias("new"), m["value"].alias("old")))
    rows = docs.select("media_id", "kind", F.explode(F.when(F.col("kind") == "v0", legacy).when(F.col("kind") == "v1", named)).alias("m")).select("media_id", "kind", "m.*")
    means = F.struct("category", "version", "ai_model_id", "file_name")
    table = model_map.groupBy("name").agg(F.collect_list(F.struct(F.col("old_version"), means.alias("means"))).alias("means"))  # a handful of rows for a name
    rows = rows.join(small(table), "name", "left")
    exact = F.filter("means", lambda m: m["old_version"] == F.col("old.version"))
    loose = F.filter("means", lambda m: m["old_version"].isNull())
    # an exact version stands in for the loose rows of its categories
    loose = F.filter(loose, lambda m: ~F.exists(exact, lambda x: x["means"]["category"] == m["means"]["category"]))
    fields = ["frame_interval", "threshold", "version", "ai_model_id", "file_name"]
    one = lambda m, specific: F.struct(m["means"]["category"].alias("category"), F.lit(specific).alias("specific"), F.struct(F.col("old.ai_model_config.frame_interval").alias("frame_interval"), F.col("old.ai_model_config.threshold").alias("threshold"), *(m["means"][n].alias(n) for n in fields[2:])).alias("m"))
    upgraded = F.concat(F.transform(exact, lambda m: one(m, True)), F.transform(loose, lambda m: one(m, False)))
    kept = F.array(F.struct(F.col("name").alias("category"), F.lit(True).alias("specific"), F.struct(*(F.col(f"new.{n}").alias(n) for n in fields)).alias("m")))
    found = rows.select("media_id", "name", F.explode(F.when(F.col("kind") == "v1", kept).otherwise(upgraded)).alias("x"))
    best = found.groupBy("media_id", F.col("x.category").alias("category")).agg(F.max_by("x.m", F.struct("x.specific", "name")).alias("m"))
    return best.select("media_id", "category", "m.*")


def listed_models(docs: DataFrame) -> DataFrame:
    """Model rows of parsed results of the format v3: media_id, name, identifier, version, categories, type."""
    return docs.select("media_id", F.inline(F.when(F.col("kind") == "v3", _at("$.models", LISTED))))


def _object(column: Column) -> Column:
    """A variant's fields by name."""
    return F.coalesce(column.cast("map<string, variant>"), F.create_map().cast("map<string, variant>"))


def _without(fields: Column, *names: str) -> Column:
    return F.map_filter(fields, lambda k, _: ~k.isin(*names))


def _put(fields: Column, **new: Column) -> Column:
    """A map of fields with some replaced by variants; those given as null stay as they are."""
    for name, value in new.items():
        entry = F.create_map(F.lit(name), value)
        fields = F.when(value.isNull(), fields).otherwise(F.map_concat(_without(fields, name), entry))
    return fields


def rewritten(docs: DataFrame, new_spans: DataFrame, new_models: DataFrame) -> DataFrame:
    """(media_id, json) in the format v1: parsed documents with all spans and models replaced, and every other field kept.

    New spans and models are those of ``results.upsert``.  What the oldest format says elsewhere than in tags and models stays under
    its names, its duration also where the newer format has it.  A media that only new spans have gets a document of its own.
    """
    each = new_spans.groupBy("media_id", "category", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "end", "confidence"))).alias("v"))
    each = each.groupBy("media_id", "category").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag", "v")))).alias("v"))
    timespans = each.groupBy("media_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "v"))).alias("timespans"))
    entry = F.struct("frame_interval", "threshold", "version", "ai_model_id", "file_name")
    listed = new_models.groupBy("media_id").agg(F.map_from_entries(F.collect_list(F.struct("category", entry.alias("v")))).alias("models"))
    rows = docs.join(timespans, "media_id", "full").join(listed, "media_id", "full")
    none = lambda kind: F.create_map().cast(kind)
    top = F.when(F.col("kind") == "v0", _without(_object(F.col("doc")), "tags")).otherwise(_object(F.col("doc")))
    length = F.coalesce(_at("$.metadata.duration", "double"), _at("$.duration", "double"), _at("$.video_metadata.duration", "double"))
    metadata = _put(_object(_at("$.metadata", "variant")), duration=length.cast("variant"), models=F.to_variant_object(F.coalesce("models", none(f"map<string, {MODEL}>"))))
    whole = _put(top, schema_version=F.lit(1).cast("variant"), timespans=F.to_variant_object(F.coalesce("timespans", none(f"map<string, {TAGS}>"))), metadata=F.to_variant_object(metadata))
    return rows.select("media_id", F.to_json(whole).alias("json"))
