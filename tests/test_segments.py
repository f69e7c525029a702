"""Clustering over segments, overlap over stretches, the search inside the passes: against folds, windows and loops."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import intervals as I
from spanloom.operators import overlap as O
from spanloom.operators import segments as G
from spanloom.operators.sizes import most_rows, small

BUCKET = "media_id long, category string, tag string, s double, e double, tc double, fi double"
SPANS = "media_id long, category string, tag string, start double, end double"


def buckets_of(r, n, far=0.05):
    at, out = 0.0, []
    for _ in range(n):
        at += 2 * r.randint(2, 8) + (r.choice([3e3, 9e4]) if r.random() < far else 0)
        e = at + 2 * r.randint(0, 6)
        out.append((at, e, r.random() * (e - at + 2), 2.0))
        at = e
    return out


@pytest.mark.parametrize("params", [{}, {"gap_factor": 3.0}, {"average_factor": 2.0}, {"min_gap": 20.0, "density_weight": 0.3}, {"gap_factor": -1.0}, {"min_gap": 1e9}])
def test_segments_equal_folds_and_windows(spark, params):
    r = random.Random(11)
    rows = [(k % 7, "c", None if k % 5 == 0 else f"t{k}", *b) for k in range(30) for b in buckets_of(r, r.randint(0, 60))]
    rows += [(1, None, "x", 5.0, 5.0, 0.0, 2.0)]
    df = spark.createDataFrame(rows, BUCKET).repartition(3)
    want = sorted(map(tuple, I.merge_buckets(df, params).select(*BUCKET_NAMES).collect()), key=repr)
    for tasks in (None, 5):
        got = sorted(map(tuple, G.merge_buckets_segmented(df, params, tasks).select(*BUCKET_NAMES).collect()), key=repr)
        assert got == want
    whole = sorted(map(tuple, I.merge_buckets_windowed(df, params).select(*BUCKET_NAMES).collect()), key=repr)
    assert whole == want


BUCKET_NAMES = [c.split()[0] for c in BUCKET.split(", ")]


@pytest.mark.parametrize("params", [{}, {"gap_factor": 2.0, "min_gap": 9.0}, {"average_factor": 1.0, "density_weight": 2.0}])
def test_no_merge_crosses_a_cut(params):
    r, p = random.Random(12), I.CLUSTER | params
    for far in (0.02, 0.3):
        s, e, tc, fi = map(np.array, zip(*buckets_of(r, 4000, far)))
        joined = G.bridgeable(s, e, tc, fi, np.ones(len(s) - 1, bool), p)
        whole = G.Pending(s, e, tc, fi, np.zeros(len(s), int), firsts=(np.arange(len(s)),), lasts=(np.arange(len(s)),)).after_passes(p)
        crossed = np.zeros(len(s) - 1, bool)
        for i, j in zip(whole.firsts[0], whole.lasts[0]):
            crossed[i:j] = True
        assert not (crossed & ~joined).any() and 10 < (~joined).sum()


def test_cuts_do_not_depend_on_batches(spark, monkeypatch):
    r = random.Random(15)
    rows = [(k, "c", "t", *b) for k, n in ((1, 9000), (2, 3), (3, 4000)) for b in buckets_of(r, n)]
    df = spark.createDataFrame(rows, BUCKET)
    whole = {(x.media_id, x.s, x.segment) for x in G.with_segments(df.coalesce(1), I.CLUSTER).collect()}
    assert len({(m, g) for m, _, g in whole}) > 20
    import pyarrow as pa

    t = df.orderBy("media_id", "s").toArrow()
    monkeypatch.setattr(G, "CHUNK_ROWS", 500)
    numbers = np.concatenate([f for _, f in G._cut(iter(t.to_batches(max_chunksize=333)), I.CLUSTER)])
    again = list(zip(t["media_id"].to_pylist(), t["s"].to_pylist(), np.cumsum(numbers).tolist()))
    order = {k: i for i, k in enumerate(sorted({(m, g) for m, _, g in again}))}
    first = {k: i for i, k in enumerate(sorted({(m, g) for m, _, g in whole}))}
    assert {(m, s, order[m, g]) for m, s, g in again} == {(m, s, first[m, g]) for m, s, g in whole}
    assert G.merge_buckets_segmented(spark.createDataFrame([], BUCKET)).count() == 0
    assert sum(x.num_rows for x, _ in G._chunks(G._cut(iter(pa.Table.from_batches(t.to_batches()).to_batches(max_chunksize=100)), I.CLUSTER))) == t.num_rows


def test_one_key_of_a_million_buckets(spark):
    """One media and tag: its segments are dealt over tasks, and time follows the number of buckets."""

    def one_key(n):
        s = F.col("id") * 30.0 + F.floor(F.col("id") / 1000) * 1e7
        return spark.range(n).select(F.lit(1).cast("long").alias("media_id"), F.lit("c").alias("category"), F.lit("t").alias("tag"), s.alias("s"), (s + (F.col("id") % 7) * 2.0).alias("e"), (F.col("id") % 5 + 0.5).alias("tc"), F.lit(2.0).alias("fi"))

    took = {}
    for n in (100_000, 1_000_000):
        merged = G.merge_buckets_segmented(one_key(n), tasks=4).cache()
        began = time.time()
        count = merged.count()
        took[n] = time.time() - began
        k = np.arange(n)
        s = k * 30.0 + k // 1000 * 1e7
        whole = G.Pending(s, s + k % 7 * 2.0, k % 5 + 0.5, np.full(n, 2.0), np.zeros(n, int)).after_passes(I.CLUSTER)
        assert count == len(whole.s) and merged.agg(F.sum("tc")).first()[0] == pytest.approx(whole.tc.sum())
        assert merged.select(F.spark_partition_id()).distinct().count() > 1
        merged.unpersist()
    assert took[1_000_000] < 40 * took[100_000]


def pieces(r, n, overlapping):
    at, out = 0.0, []
    for _ in range(n):
        at += r.randint(0, 9)
        length = r.randint(0, 300 if overlapping else 9)
        out.append((at, at + length))
        at += r.randint(0, 5) if overlapping else length
    return out


@pytest.mark.parametrize("overlapping", [False, True])
def test_stretches_equal_all_pairs(spark, overlapping):
    r = random.Random(13)
    a, d = ({(k, None if k == 3 else "c"): pieces(r, r.randint(0, 40), overlapping) for k in range(12)} for _ in range(2))
    frame = lambda g: spark.createDataFrame([(k, c, "t", x, y) for (k, c), s in g.items() for x, y in s], SPANS)
    shared = {k: sum(max(0.0, min(x[1], y[1]) - max(x[0], y[0])) for x in a[k] for y in d[k]) for k in a}
    for span in (None, 10.0, 1e6):
        assert {(x.media_id, x.category): x.shared for x in O.overlap(frame(a), frame(d), I.KEY, span).collect()} == {k: v for k, v in shared.items() if v}
        size = lambda s: sum(y - x for x, y in s)
        assert {(x.media_id, x.category): x.loss for x in O.loss(frame(a), frame(d), span).collect()} == {k: size(a[k]) + size(d[k]) - 2 * shared[k] for k in d if d[k]}
        assert O.loss(frame(a).limit(0), frame(d).limit(0), span).count() == 0


def test_one_key_over_many_tasks(spark):
    base = spark.range(200_000).select(F.lit(1).cast("long").alias("media_id"), F.lit("c").alias("category"), F.lit("t").alias("tag"), (F.col("id") * 10.0).alias("start"))
    a, d = base.withColumn("end", F.col("start") + 6), base.withColumn("end", F.col("start") + 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        swept = O.sweep(a, d, I.KEY, span=100_000.0)
        assert swept.first().shared == 800_000.0
        rows = a.withColumn("part", F.floor(F.col("start") / 100_000.0)).repartition("media_id", "category", "tag", "part")
        assert rows.select(F.spark_partition_id()).distinct().count() > 1  # the sweep's own exchange
        assert "part" in swept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_search_equals_every_combination_alone(spark):
    r = random.Random(14)
    df = spark.createDataFrame([(k % 4, "c", f"t{k % 3}", *b) for k in range(12) for b in buckets_of(r, 40)], BUCKET).dropDuplicates(["media_id", "category", "tag", "s"])
    df = I.adjacency_buckets(df.select("media_id", "category", "tag", F.col("s").alias("start"), F.col("e").alias("end"), F.lit(0.7).alias("confidence")).where("media_id < 3"), F.lit(2.0)).cache()
    wanted = spark.createDataFrame([(k, "c", "t1", x, x + 40.0) for k in range(1, 4) for x in (0.0, 90.0, 5000.0)], SPANS)
    choices = {"density_weight": [0.0, 0.2], "gap_factor": [0.7, 1.0], "average_factor": [0.0, 0.4], "min_gap": [0.0, 6.0]}
    got = O.grid_search(df, wanted, O.parameter_grid(spark, **choices), 6.0, top=16).collect()
    assert len(got) == 16 and [g.loss for g in got] == sorted(g.loss for g in got)
    for g in got:
        actual = I.keep_long(I.merge_buckets(df, params={n: g[n] for n in choices}), F.lit(6.0))
        off = abs(actual.count() - wanted.count())
        assert g.mismatch == off and g.loss == pytest.approx(O.loss(actual, wanted).agg(F.sum("loss")).first()[0] + 2 * off)
    none = O.grid_search(df.limit(0), wanted.limit(0), O.parameter_grid(spark, gap_factor=[1.0, 2.0]), 6.0).collect()
    assert [tuple(x) for x in none] == [(1.0, 0.0, 0), (2.0, 0.0, 0)]


def test_default_sweep_size():
    assert np.prod([len(v) for v in O.DEFAULT_SWEEP.values()]) == 3200


def test_proven_sizes_need_no_job(spark):
    assert most_rows(spark.sql("select * from values (1), (2) as t(a)")) == 2
    assert most_rows(spark.range(5).limit(3)) == 3 and most_rows(spark.range(9).groupBy().count()) == 1
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(small(spark.createDataFrame([(1,)], "a int"))) and not hinted(small(spark.range(50), limit=10))


@pytest.mark.parametrize("proportion", [0.0, 0.5, 2.0])
def test_streamed_proportional_merging_equals_the_fold(spark, proportion):
    r = random.Random(16)
    rows = []
    for k in range(40):
        at = 0.0
        for _ in range(r.randint(1, 40)):
            at += 2 * r.randint(1, 9)
            end = r.choice([None, at + 2 * r.randint(1, 5)])
            rows.append((k % 9, None if k % 7 == 0 else "c", f"t{k}", at, end, float(k % 3), float(k % 5)))
            at = end or at
    kinds = "media_id long, category string, tag string, start double, end double, max_gap double, min_marker_duration double"
    df = spark.createDataFrame(rows + [rows[0]], kinds).repartition(3)
    got = G.merge_proportional_streamed(df, "2.0D", proportion)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, I.merge_proportional(df, "2.0D", proportion).collect()), key=repr)
    assert got.count() > 50 and G.merge_proportional_streamed(df.limit(0), "2.0D").count() == 0


def test_streamed_proportional_merging_is_linear(spark):
    s = F.col("id") * 20.0
    df = spark.range(300_000).select(F.lit(1).cast("long").alias("media_id"), F.lit("c").alias("category"), F.lit("t").alias("tag"), s.alias("start"), (s + 8).alias("end"), F.lit(4.0).alias("max_gap"), F.lit(6.0).alias("min_marker_duration"))
    assert G.merge_proportional_streamed(df, "2.0D").count() == 300_000
