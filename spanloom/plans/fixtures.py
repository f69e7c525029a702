"""The driver's tables seen as detections, media, rules, scores and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import RULE_DEFAULTS, duration_literal, number, or_default
from ..operators.scoring import Head, linear_scores

INTERVAL, DURATION, THRESHOLD, LEAST = 6.0, 720.0, 0.3, 12.0
RULES = [
    ("engagement", "view", "Viewing", "12", "6", "20", ""),
    ("engagement", "click", "Clicking", "5%", "12s", "10%", "0.4"),
    ("conversion", "purchase", "Buying", "12s", "", "20", "0.3"),
    ("conversion", "signup", "Joining", "0", "6", "0", "0.5"),
    ("system", "error", "Failing", "abc", "6", "20s", "0.5"),
]
WEIGHTS = [((j * 37) % 11 - 5) / 10 for j in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str, decimals: int = 2) -> DataFrame:
    """events as detections: six-hour frames, the best confidence of each."""
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    kind = F.col("event_type")
    category = F.when(kind.isin("view", "click"), "engagement").when(kind.isin("purchase", "signup"), "conversion").otherwise("system")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("media_id"), category.alias("category"), kind.alias("tag"), (F.floor(seconds / 21600.0) * 6.0).alias("frame_index"))
        .agg(F.max(F.round(F.col("value") / (F.col("value") + 50.0), decimals)).alias("confidence"))
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id")).distinct().withColumn("duration", F.lit(DURATION))


def rule_rows(spark: SparkSession) -> DataFrame:
    """The rule table as read from files: all strings."""
    names = "category, tag, display, min_marker_duration, max_gap, required_duration, tag_threshold"
    rows = ", ".join("(" + ", ".join(f"'{cell}'" for cell in row) + ")" for row in RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules({names})")


def nation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nations as rule rows: cells by the key."""
    k = F.col("n_nationkey")
    cell = lambda i: F.when((k + i) % 4 == 0, "").when((k + i) % 4 == 1, F.lit(None)).when((k + i) % 4 == 2, F.concat(k.cast("string"), F.lit("s"))).otherwise(F.concat((k + i).cast("string"), F.lit("%")))
    names = ["min_marker_duration", "max_gap", "required_duration"]
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("category"), F.col("n_name").alias("tag"), F.col("n_name").alias("display"), *(cell(i).alias(n) for i, n in enumerate(names)), F.when(k % 3 > 0, F.concat(F.lit("0."), k)).alias("tag_threshold"))


def resolved(rows: DataFrame, duration: float = DURATION, configured: dict[str, str] | None = None) -> DataFrame:
    """Rule cells as numbers, for media of one duration."""
    cell = {k: or_default(F.col(k), (configured or {}).get(k), v) for k, v in RULE_DEFAULTS.items()}
    lengths = {k: duration_literal(c, F.lit(duration)) for k, c in cell.items() if k != "tag_threshold"}
    return rows.select("category", "tag", "display", *(c.alias(k) for k, c in lengths.items()), number(cell["tag_threshold"]).alias("tag_threshold"))


def rules(spark: SparkSession) -> DataFrame:
    return resolved(rule_rows(spark))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as the frames of suppliers' media; the order key makes ordinals unique."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("media_id"), (F.row_number().over(w) - 1).cast("long").alias("n"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dimensions of embeddings as logits."""
    probability = F.transform("embedding", lambda x: 1.0 / (1.0 + F.exp(-8.0 * x.cast("double"))))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("media_id"), F.col("label").cast("double").alias("frame_index"), F.lit("m1").alias("model"), probability.alias("scores"))


def tags(spark: SparkSession) -> DataFrame:
    return spark.range(64).select(F.lit("m1").alias("model"), F.col("id").cast("int").alias("idx"), F.concat(F.lit("t"), F.col("id")).alias("name"))


def mappings(spark: SparkSession) -> DataFrame:
    """Index to category; the last index has none."""
    return spark.range(63).select(F.lit("m1").alias("model"), F.col("id").cast("int").alias("idx"), F.concat(F.lit("c"), F.col("id") % 3).alias("category"))


def image_rule_rows(spark: SparkSession) -> DataFrame:
    return spark.range(6).select(
        F.concat(F.lit("c"), F.col("id") % 3).alias("category"), F.concat(F.lit("t"), F.col("id")).alias("tag"),
        F.concat(F.lit("Tag "), F.col("id")).alias("display"), (0.4 + F.col("id") * 0.05).alias("tag_threshold"),
    )


def stored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as media with one stored model in each of two categories."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("media_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("category"), k.alias("k"))
    rows = rows.where("category = 'a' or k % 4 <> 0")
    return rows.select(
        "media_id", "category", (1.0 + F.col("k") % 3).alias("frame_interval"), (0.1 * (F.col("k") % 5)).alias("threshold"),
        (1.0 + F.col("k") % 2).alias("version"), F.when(F.col("k") % 7 == 0, 950).otherwise(200 + F.col("k") % 4).cast("int").alias("ai_model_id"),
        F.concat(F.lit("f"), F.col("k") % 6).alias("file_name"),
    )


def active_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("media_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("category"))
    return rows.select("media_id", "category", F.lit(6.0).alias("frame_interval"), F.lit(0.3).alias("threshold"), F.lit(2.0).alias("version"), F.lit(201).alias("ai_model_id"), F.lit("f1").alias("file_name"))


def nation_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nations as models."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), k.alias("identifier"), (k % 3).cast("double").alias("version"),
        F.array(F.concat(F.lit("c"), k % 7), F.concat(F.lit("d"), k % 5)).alias("categories"),
        F.when(k % 2 == 0, 224).otherwise(384).alias("image_size"), (k % 2).alias("norm"), F.concat(F.lit("p"), F.col("n_regionkey")).alias("pipeline"),
    )


def v0_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results in the oldest format, one for each customer key up to the table's end."""
    k = F.col("c_custkey")
    frame = F.struct(F.lit(0.0).alias("start"), (k % 9).cast("double").alias("end"), F.lit(0.5).alias("confidence"))
    single = F.struct((k % 5 + 20).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(0.75).alias("confidence"))
    settings = F.struct(F.lit(2.0).alias("frame_interval"), F.lit(0.3).alias("threshold"))
    models = F.create_map(F.when(k % 3 == 0, "old_one").when(k % 3 == 1, "old_two").otherwise("unheard"), F.struct((k % 2 + 1).cast("double").alias("version"), settings.alias("ai_model_config")))
    meta = F.struct(k.alias("video_id"), F.lit(60.0).alias("duration"), models.alias("models"))
    found = F.create_map(F.lit("view"), F.struct(F.lit("old_one").alias("ai_model_name"), F.array(frame, single).alias("time_frames")), F.concat(F.lit("x"), k % 2), F.struct(F.lit("old_two").alias("ai_model_name"), F.array(single).alias("time_frames")))
    return table(spark, sf_dir, "customer").select(k.alias("media_id"), F.to_json(F.struct(meta.alias("video_metadata"), found.alias("tags"))).alias("json"))


def v0_model_map(spark: SparkSession) -> DataFrame:
    rows = [("old_one", 2.0, "actions", 2.0, 200, "new_one"), ("old_one", None, "actions", 0.1, 950, None), ("old_two", None, "parts", 0.5, 200, "new_two"), ("old_two", None, "actions", 2.0, 200, "new_one")]
    return spark.createDataFrame(rows, "name string, old_version double, category string, version double, ai_model_id int, file_name string")


def heads(count: int = 3, tags: int = 8, dims: int = 64) -> list[Head]:
    """Linear models with weights from a rule; the last tag has no category."""
    made = []
    for h in range(count):
        weights = [[((j * 37 + t * 11 + h * 5) % 13 - 6) / 10 for j in range(dims)] for t in range(tags)]
        categories = [None if t == tags - 1 else f"c{(t + h) % 4}" for t in range(tags)]
        made.append(Head(f"m{h}", linear_scores(weights, [(t - 4) / 10 for t in range(tags)]), [f"t{h}_{t}" for t in range(tags)], categories, dims, 0.55))
    return made


def outputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """events as models' outputs on daily frames, and each user's announcement of 1 to 5 frames and one or two models."""
    day = F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))") / 86400)
    e = table(spark, sf_dir, "events")
    models = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("view"))).otherwise(F.array(F.lit("view"), F.lit("click")))
    told = e.groupBy("user_id").agg(F.min("ts").alias("ts")).select(F.col("user_id").alias("media_id"), (1 + F.col("user_id") % 5).alias("frames"), models.alias("models"), "ts")
    return e.select(F.col("user_id").alias("media_id"), day.alias("frame"), F.col("event_type").alias("model"), "ts"), told
