"""The corpus pipeline: toxicity, line dedup, near-duplicates, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs; all but the last return the columns of
documents, also further ones with any names.  Stage results are written as Parquet in the shared folder and read
again, so a lost executor costs at most a stage's own tasks.

In every stage an empty table gives an empty one, a null text counts as an empty one and stays null, and texts of
any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.bpe import bpe_columns
from spanloom.llm.line_dedup import WHOLE, dedup_lines
from spanloom.llm.minhash_dedup import near_duplicates
from spanloom.llm.mixing import poisson_mix
from spanloom.llm.registry import WORD_BPE, vocabulary
from spanloom.llm.shared import stash, table
from spanloom.llm.toxicity import drop_toxic

#: Target shares of the mixed corpus, and its size as a multiple of the distinct documents (two epochs).
WEIGHTS, EPOCHS = {"src0": 0.25, "*": 0.75}, 2.0


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    Null and empty texts have the model's base score, which rejects none; repeated rows share one fate; documents without a label
    are judged like all others.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those made only of repeats go.  n_chars follows the text.

    Of equal or similar lines one stays, as ``dedup_lines`` has it; documents from which nothing is removed keep their n_chars, null or
    not.
    """
    kept = dedup_lines(docs, **WHOLE).where("has_own")
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length).select(*docs.columns)


def keep_one_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id; of repeated rows, one.

    Texts without words are in no group and stay; all rows without doc_id count as one document.
    """
    marks = stash(near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id")))
    groups = marks.distinct()
    one = docs.join(groups, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return one if marks.count() == groups.count() else one.dropDuplicates(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights, in a global shuffle.

    A null source counts to the group of all others; copies of a row are equal rows; a document whose drawn count is 0 is left out, by design of
    the method.
    """
    return poisson_mix(docs, WEIGHTS, budget=EPOCHS, keep=docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token counts and digests of ids and decoded text; columns of those names are replaced."""
    return bpe_columns(docs, vocabulary(WORD_BPE))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", remove_lines),
    ("minhash_dedup", keep_one_each),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The stages' models, components and encodings are beyond SQL; a test holds run() against brute force over all pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
