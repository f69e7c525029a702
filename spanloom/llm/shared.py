"""Small things that several corpus operators need: shared-folder tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one or two longs that a broadcast may hold: about 24 bytes each in a hashed relation.
BROADCAST_ROWS = 1_000_000
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or the context's checkpoint directory.

    Only where both are unset and everything runs in this one process's machine (local mode, as in tests), a new
    local one; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            fs, p = _path(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder's own retention applies
            return


def drop(df: DataFrame) -> None:
    """Delete a table that ``stash`` wrote, once nothing reads it any more."""
    path = getattr(df, "_stashed", None)
    if path:
        fs, p = _path(df.sparkSession, path)
        fs.delete(p, True)


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spanloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most ``limit`` rows; otherwise for a shuffled join."""
    return F.broadcast(df) if df.count() <= limit else df.hint("merge")


def least_count(counts: DataFrame, most: int, low: float = 1) -> float:
    """The smallest count, ``low`` at least, that at most ``most`` rows of ``counts(n)`` reach; inf where none does.

    From a histogram of count ranges (a sixteenth of an octave each), so what comes to the driver is a few hundred
    rows for any table; a sorted limit would send ``most`` rows from every task.
    """
    steps = F.floor(F.log2(F.col("n").cast("double")) * 16 + 1e-9).cast("int")
    bars = sorted(((r.s, r.k) for r in counts.where(F.col("n") >= low).groupBy(steps.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)
    held, edge = 0, float("inf")
    for step, k in bars:
        held += k
        if held > most:
            return edge
        edge = max(low, float(np.ceil(2 ** (step / 16) - 1e-6)))
    return low


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column):
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_remote(path: str) -> bool:
    return urlparse(path).scheme not in ("", "file")
