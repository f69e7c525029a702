"""Connected groups of near-duplicates from candidate buckets, without ever making all pairs of a bucket.

1. Each bucket's smallest id is its hub; every other member is checked against the hub (a star, so as many
   pairs as members).  One large group of near copies is mostly joined here.
2. Components of the confirmed links.
3. A bucket whose members now have one component is settled: more pairs could not change the result.  In the
   others, each member outside the hub's component (an outlier) is compared with all members, block by block
   inside tasks that emit only one confirmed link for each (outlier, component).
4. Components again.  Every pair of a bucket has then been compared or was in one component already, so no
   link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, stash

#: Payload units (shingles) in one block of one task, which compares at most so many with as many.
BLOCK_UNITS = 250_000


def connected_components(links: DataFrame) -> DataFrame:
    """``(a, b)`` links to ``(id, component)``: each linked id's smallest reachable id.

    Alternating large-star and small-star passes; a centre's smallest neighbour comes from a partially
    aggregated ``min`` and goes back by a join that adaptive execution can split, so a hub of any degree is no
    single task.  Ids without a link have no row.  Null ends and self links are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stash(edges)
    mark = None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stash(small.unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(edges)
        edges = new
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stash(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots))


#: Rows after which whole groups are handed to the block function.
CHUNK_ROWS = 20_000


def whole_groups(block: Callable[[pa.Table, np.ndarray], pa.Table]):
    """Rows sorted by (key, bq, bx) to the results of ``block(rows, group number of each row)`` for many whole groups at a time.

    A group is bounded by its two blocks, so what is held is one chunk and one group; a call for each small group
    would cost far more than its few pairs.
    """

    def number(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        for c in ("key", "bq", "bx"):
            v = rows[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < CHUNK_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            group = number(rows)
            cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if cut:
                yield from block(rows.slice(0, cut), group[:cut]).to_batches()
            held = rows.slice(cut).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield from block(rows, number(rows)).to_batches()

    return run


def link_buckets(
    stars: DataFrame,
    coarse: DataFrame,
    items: Callable[[DataFrame], DataFrame],
    verify: Callable[[DataFrame], DataFrame],
    block: Callable[[pa.Table, np.ndarray], pa.Table],
    sizes: DataFrame | None = None,
    block_units: int = BLOCK_UNITS,
) -> DataFrame:
    """Components ``(id, component)`` over the confirmed links.

    stars: candidate ``(a, b)`` of each bucket's hub and its other members; coarse: ``(key, id)`` whose groups
    hold every other pair that shares a bucket; items: from wanted ``(id)`` to ``(id, payload...)``; verify:
    candidate ``(a, b)`` to confirmed ``(a, b)``; block: rows ``(q boolean, x boolean, component, id, payload...)`` of
    many groups, and their group numbers, to confirmed links within groups; sizes: ``(id, units)``, or None for one unit each; block_units: a block's units, on either side of a task.
    """
    spark = stars.sparkSession
    links = stash(verify(stars))
    parts = connected_components(links)

    known = coarse.join(parts, "id", "left")
    known = known.join(sizes, "id") if sizes is not None else known.withColumn("units", F.lit(1))
    known = stash(known.select("key", "id", F.col("units").cast("long").alias("_u"), F.coalesce("component", "id").alias("component")))
    main = (
        known.groupBy("key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("component", "id").alias("main"))
        .where("lo <> hi")
        .select("key", "main")
    )
    open_rows = known.join(main, "key")
    out = F.col("component") != F.col("main")
    blocks = lambda total: F.greatest(F.lit(1), F.ceil(total / block_units)).cast("int")
    dealt = open_rows.groupBy("key").agg(
        blocks(F.sum("_u")).alias("nx"), blocks(F.sum(F.when(out, F.col("_u")))).alias("nq")
    )
    open_rows = open_rows.join(dealt, "key").withColumn("out", out)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    many = (F.col("nx") > 1) | (F.col("nq") > 1)
    # a small group is one task, where outliers are both sides; larger ones are dealt as query block x index block
    tasks = open_rows.select(
        "key", "id", "component",
        F.explode(
            F.when(~many, F.array(F.struct(F.lit(0).alias("bq"), F.lit(0).alias("bx"), F.col("out").alias("q"), F.lit(True).alias("x"))))
            .otherwise(
                F.concat(
                    F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda k: F.struct(k.alias("bq"), own("nx").alias("bx"), F.lit(False).alias("q"), F.lit(True).alias("x"))),
                    F.when(F.col("out"), F.transform(F.sequence(F.lit(0), F.col("nx") - 1), lambda k: F.struct(own("nq").alias("bq"), k.alias("bx"), F.lit(True).alias("q"), F.lit(False).alias("x")))).otherwise(F.expr("array()")),
                )
            )
        ).alias("t"),
    ).select("key", "t.*", "id", "component")
    tasks = stash(tasks)
    # an explicit count, since what a task costs are pairs, not the bytes that adaptive coalescing goes by
    dealt = tasks.join(items(tasks.select("id").distinct()), "id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "bq", "bx").sortWithinPartitions("key", "bq", "bx")
    more = dealt.mapInArrow(whole_groups(block), "a long, b long")
    more = stash(more.distinct())
    joined = links.unionAll(more)
    done = connected_components(joined)
    for x in (parts, known, tasks):
        drop(x)
    return done
