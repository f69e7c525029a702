"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a broadcast side may have; configuration tables have far fewer.
BROADCAST_ROWS = 200_000


def most_rows(df: DataFrame) -> int | None:
    """Rows that ``df`` can have at most as its plan proves (literal rows, limits, global aggregates), without a job; None if it proves nothing."""
    known = df._jdf.queryExecution().optimizedPlan().maxRows()
    return int(known.get()) if known.isDefined() else None


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its plan proves, or a count finds, at most ``limit`` rows; otherwise as it is, for a shuffled join."""
    proven = most_rows(df)
    fits = proven <= limit if proven is not None and proven <= limit else df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if fits else df
