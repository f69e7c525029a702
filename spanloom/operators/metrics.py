"""Run metrics, consistency checks and model picking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def apportion(batches: DataFrame) -> DataFrame:
    """O-81: (batch, root, elapsed, items) to each root's share of its batch's time, by items."""
    share = F.col("elapsed") * F.col("items") / F.sum("items").over(Window.partitionBy("batch"))
    return batches.select("batch", "root", share.alias("seconds"))


def request_metrics(runs: DataFrame) -> DataFrame:
    """O-80, O-82, O-83: runs(request, backend, preprocess_s, inference_s, frames) to a row each request."""
    total = F.sum(F.col("preprocess_s") + F.col("inference_s"))
    return runs.groupBy("request").agg(
        F.sum("preprocess_s").alias("preprocess_s"), F.sum("inference_s").alias("inference_s"), F.sum("frames").alias("frames"),
        F.when(F.sum("frames") > 0, F.sum("preprocess_s") / F.sum("frames")).alias("s_per_frame"),
        total.alias("total_s"), F.when((total > 0) & (F.sum("frames") > 0), F.sum("frames") / total).alias("frames_per_s"),
        F.when(F.count_distinct("backend") == 1, F.min("backend")).when(F.count_distinct("backend") > 1, "mixed").alias("backend"),
    )


def health(models: DataFrame) -> DataFrame:
    """O-84: models of each pipeline, and of all as pipeline "total"."""
    each = models.groupBy("pipeline").agg(F.count("*").alias("models"))
    return each.unionByName(models.agg(F.count("*").alias("models")).select(F.lit("total").alias("pipeline"), "models"))


def uniform(models: DataFrame, group: str, *columns: str) -> DataFrame:
    """O-86: whether all models of a group agree on each of the columns."""
    agree = F.lit(True)
    for c in columns:
        agree = agree & (F.col(f"n_{c}") <= 1)
    counts = models.groupBy(group).agg(*(F.count_distinct(c).alias(f"n_{c}") for c in columns))
    return counts.select(group, agree.alias("uniform"))


def pick_order(models: DataFrame) -> DataFrame:
    """O-92: by first category, then identifier (then name, for ties)."""
    return models.withColumn("first_category", F.element_at("categories", 1)).orderBy("first_category", "identifier", "name")


def available(models: DataFrame, active: DataFrame) -> DataFrame:
    """O-95: models that are not active."""
    return models.join(active.select("name"), "name", "left_anti")


def compatible(models: DataFrame, active: DataFrame) -> DataFrame:
    """O-96: models of an active model's image size that share no category with an active one."""
    sizes = active.select("image_size").distinct()
    taken = active.select(F.explode("categories").alias("category")).distinct()
    clash = models.select("name", F.explode("categories").alias("category")).join(taken, "category", "left_semi").select("name")
    return models.join(sizes, "image_size", "left_semi").join(clash, "name", "left_anti")
