"""Files through Spark's own readers, so that they may lie in any store: rules, vocabularies, results, listings."""

from __future__ import annotations

import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizes import small

#: The columns of a rule file.
RULE_COLUMNS = ["OriginalTag", "RenamedTag", "MinMarkerDuration", "MaxGap", "RequiredDuration", "TagThreshold"]


def listing(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """(path below root, content) of all files; with content off only paths and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.regexp_replace(F.col("path"), r"^[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/")
    base = "/" + root.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
    rel = F.substring_index(below, base, -1)
    return files.select(rel.alias("path"), "content") if content else files.select(rel.alias("path"), F.col("length").alias("bytes"))


def with_existence(rows: DataFrame, path: Column, listed: DataFrame, name: str = "known") -> DataFrame:
    """O-5, O-6: ``rows`` with whether ``path`` is among listed(path): a join, so a listing of any length; false for null."""
    there = listed.select(F.col("path").alias("_path")).distinct().withColumn("_there", F.lit(True))
    joined = rows.withColumn("_wanted", path).join(small(there), F.col("_wanted") == F.col("_path"), "left")
    return joined.withColumn(name, F.coalesce("_there", F.lit(False))).drop("_wanted", "_path", "_there")


def rule_files(spark: SparkSession, root: str) -> DataFrame:
    """O-16: all CSV files under root, every cell a string; a file's stem is its category."""
    rows = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("header", True)
        .schema(", ".join(f"{c} string" for c in RULE_COLUMNS)).csv(root)
    )
    stem = F.regexp_extract(F.input_file_name(), r"([^/]*)\.csv$", 1)
    return rows.select(
        F.url_decode(stem).alias("category"), F.col("OriginalTag").alias("tag"), F.col("RenamedTag").alias("display"), F.col("MinMarkerDuration").alias("min_marker_duration"),
        F.col("MaxGap").alias("max_gap"), F.col("RequiredDuration").alias("required_duration"), F.col("TagThreshold").alias("tag_threshold"),
    )


def tag_vocabulary(spark: SparkSession, path: str, model: str) -> DataFrame:
    """O-15: a tag a line, stripped; the index is the line's number from 0."""
    text = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    return text.select(F.lit(model).alias("model"), F.posexplode(lines).alias("idx", "name")).select("model", "idx", F.trim("name").alias("name"))


def stored_results(spark: SparkSession, root: str) -> DataFrame:
    """O-18: JSON results, one a file named by its media id."""
    files = listing(spark, root)
    return files.select(F.regexp_extract("path", r"([0-9]+)\.json$", 1).try_cast("long").alias("media_id"), F.decode("content", "UTF-8").alias("json"))


def write_results(results: DataFrame, path: str) -> None:
    """O-19: (media_id, json) as JSON lines with the id in front of each text."""
    results.select(F.concat(F.lit('{"media_id":'), F.col("media_id"), F.lit(',"result":'), F.col("json"), F.lit("}")).alias("value")).write.text(path)


def load_config(path: str, defaults: dict) -> dict:
    """O-17: a YAML (or JSON) file's top level over the defaults; a missing or malformed file leaves them, with a warning."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            import yaml

            found = yaml.safe_load(text)
        except ImportError:
            found = json.loads(text)
        return defaults | (found or {})
    except (OSError, ValueError) as e:
        logging.getLogger(__name__).warning("%s: %s; defaults apply", path, e)
        return dict(defaults)
    except Exception as e:  # noqa: BLE001  the parser's own error class, where it is installed
        logging.getLogger(__name__).warning("%s cannot be parsed: %s; defaults apply", path, e)
        return dict(defaults)
