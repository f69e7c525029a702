"""Interval operators: hand-made cases and sequential folds in plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.operators import intervals as I
from spanloom.operators import overlap as O

DET = "media_id long, category string, tag string, frame_index double, confidence double"
SPAN = "media_id long, category string, tag string, start double, end double, confidence double"
RULE = "category string, tag string, display string, min_marker_duration double, max_gap double, required_duration double, tag_threshold double"


def series(r, n):
    return [(2.0 * k, r.choice([0.5, 0.7, None])) for k in sorted(r.sample(range(3 * n + 1), n))]


def runs(rows, fi, most):
    out = []
    for f, c in rows:
        if out and f - (out[-1][1] if out[-1][1] is not None else out[-1][0]) - fi <= most and c == out[-1][2]:
            out[-1][1] = f
        else:
            out.append([f, None, c])
    return [tuple(x) for x in out]


def test_runs_equal_the_fold(spark):
    r = random.Random(1)
    groups = {k: series(r, r.randint(0, 25)) for k in range(60)}
    rows = [(k, "c", "t", f, c) for k, s in groups.items() for f, c in s]
    r.shuffle(rows)
    det = spark.createDataFrame(rows, DET).repartition(7)
    for most in (0.0, 2.0, 4.0):
        got = {}
        for x in I.run_lengths(det, F.lit(2.0), most).collect():
            got.setdefault(x.media_id, []).append((x.start, x.end, x.confidence))
        assert {k: sorted(v, key=lambda y: y[0]) for k, v in got.items()} == {k: runs(s, 2.0, most) for k, s in groups.items() if s}


@pytest.mark.parametrize(
    "frames, most, expected",
    [
        ([(4, 0.7)], 0, [(4, None)]),
        ([(0, 0.7), (2, 0.7), (4, 0.7)], 0, [(0, 4)]),
        ([(0, 0.7), (2, 0.8)], 0, [(0, None), (2, None)]),
        ([(0, None), (6, None)], 4, [(0, 6)]),
        ([(0, None), (8, None)], 4, [(0, None), (8, None)]),
        ([(0, None), (2, None)], 0, [(0, 2)]),
    ],
)
def test_run_edges(spark, frames, most, expected):
    det = spark.createDataFrame([(1, "c", "t", float(f), c) for f, c in frames], DET)
    assert sorted((x.start, x.end) for x in I.run_lengths(det, F.lit(2.0), float(most)).collect()) == expected


def random_spans(r, n):
    out, at = [], 0.0
    for _ in range(n):
        at += r.choice([0.0, 2.0, 4.0, 8.0, 20.0])
        end = None if r.random() < 0.3 else at + 2.0 * r.randint(1, 6)
        out.append((at, end, round(r.uniform(0.2, 1.0), 2)))
        at = (at if end is None else end) + 2.0
    return out


def pos(s):
    return s[1] if s[1] is not None else s[0]


def gap_fold(spans, fi, gap, least, proportion=None):
    out = []
    for s in spans:
        if out:
            g = s[0] - pos(out[-1]) - fi
            length = out[-1][1] - out[-1][0] if out[-1][1] is not None else 0.0
            if g <= gap or proportion is not None and g <= proportion * length:
                out[-1] = [out[-1][0], pos(s)]
                continue
        out.append([s[0], s[1]])
    return [tuple(x) for x in out if x[1] is not None and x[1] - x[0] >= least]


def cluster_fold(spans, fi, p, least, passes=10):
    buckets = []
    for s in spans:
        e = pos(s)
        if buckets and s[0] - buckets[-1][1] == fi:
            b = buckets[-1]
            buckets[-1] = (b[0], e, b[2] + s[2] * (e - b[0] + fi))
        else:
            buckets.append((s[0], e, s[2] * (e - s[0] + fi)))
    weight = lambda b: (b[1] - b[0] + fi) * (1 + p["density_weight"] * (b[2] / (b[1] - b[0] + fi)))
    for _ in range(passes):
        out, k = [], 0
        while k < len(buckets):
            if k + 1 < len(buckets):
                a, b = buckets[k], buckets[k + 1]
                if b[0] - a[1] - fi <= p["min_gap"] + (min(weight(a), weight(b)) + abs(weight(a) - weight(b)) * p["average_factor"]) * p["gap_factor"]:
                    out.append((a[0], b[1], a[2] + b[2]))
                    k += 2
                    continue
            out.append(buckets[k])
            k += 1
        buckets = out
    return [b for b in buckets if b[1] - b[0] + fi >= least]


def test_merging_equals_the_folds(spark):
    r = random.Random(2)
    groups = {k: random_spans(r, r.randint(1, 40)) for k in range(80)}
    rows = [(k, "c", "t", *s) for k, g in groups.items() for s in g]
    r.shuffle(rows)
    rules = spark.createDataFrame([("c", "t", "T", 6.0, 4.0, 20.0, 0.4)], RULE)
    spans = spark.createDataFrame(rows, SPAN)
    ruled = I.with_rules(spans, rules)
    kept = {k: [s for s in g if s[2] >= 0.4] for k, g in groups.items()}

    def by(df, *cols):
        out = {k: [] for k in groups}
        for x in df.collect():
            out[x.media_id].append(tuple(x[c] for c in cols))
        return {k: sorted(v) for k, v in out.items()}

    assert by(I.merge_gaps(ruled, F.lit(2.0)), "start", "end") == {k: gap_fold(g, 2.0, 4.0, 6.0) for k, g in kept.items()}
    assert by(I.merge_proportional(ruled, "2.0D"), "start", "end") == {k: gap_fold(g, 2.0, 4.0, 6.0, 0.5) for k, g in kept.items()}
    buckets = I.adjacency_buckets(ruled, F.lit(2.0))
    expected = {k: [(a, b, round(c, 6)) for a, b, c in cluster_fold(g, 2.0, I.CLUSTER, 6.0)] for k, g in kept.items()}
    for merge in (I.merge_buckets, I.merge_buckets_windowed):
        got = I.keep_long(merge(buckets), F.lit(6.0)).withColumn("total_confidence", F.round("total_confidence", 6))
        assert by(got, "start", "end", "total_confidence") == expected


def test_the_pass_cap_is_not_a_fixpoint(spark):
    rows = [(1, "c", "t", 10.0 * k, None, 0.9) for k in range(3000)]
    buckets = I.adjacency_buckets(spark.createDataFrame(rows, SPAN), F.lit(2.0))
    params = {"gap_factor": 5.0}
    expected = cluster_fold([r[3:] for r in rows], 2.0, I.CLUSTER | params, 0.0)
    assert len(expected) > 1
    for merge in (lambda b: I.merge_buckets(b, params=params), lambda b: I.merge_buckets_windowed(b, params)):
        assert sorted((x.s, x.e) for x in merge(buckets).collect()) == [(a, b) for a, b, _ in expected]


def test_totals_keep_zeros_and_null_confidence(spark):
    rules = spark.createDataFrame([("c", "a", "A", 6.0, 4.0, 4.0, 0.5), ("c", "b", "A", 6.0, 4.0, 0.0, 0.5), ("c", "z", "Z", 6.0, 4.0, 5.0, 0.5)], RULE)
    spans = spark.createDataFrame([(1, "c", "a", 0.0, None, None), (1, "c", "a", 10.0, 12.0, 0.5), (1, "c", "b", 0.0, 2.0, 0.4), (2, "c", "a", 0.0, 8.0, 0.0)], SPAN)
    media = spark.createDataFrame([(1, 60.0), (2, 60.0), (3, 60.0)], "media_id long, duration double")
    sums = I.totals(spans, rules, F.lit(2.0), media)
    assert {(x.media_id, x.tag): x.total for x in sums.collect()} == {(1, "a"): 6.0, (1, "b"): 0.0, (1, "z"): 0.0, (2, "a"): 10.0, (2, "b"): 0.0, (2, "z"): 0.0, (3, "a"): 0.0, (3, "b"): 0.0, (3, "z"): 0.0}
    assert sorted(tuple(x) for x in I.assigned_tags(sums).collect()) == [(1, "c", "A"), (2, "c", "A")]


def disjoint(r):
    out, at = [], 0.0
    for _ in range(r.randint(0, 8)):
        at += r.randint(1, 9)
        out.append((at, at + r.randint(1, 9)))
        at = out[-1][1]
    return out


def test_overlap_loss_and_counts(spark):
    r = random.Random(5)
    a, d = {k: disjoint(r) for k in range(40)}, {k: disjoint(r) for k in range(40)}
    frame = lambda g: spark.createDataFrame([(k, "c", "t", float(x), float(y)) for k, s in g.items() for x, y in s], "media_id long, category string, tag string, start double, end double")
    shared = {k: sum(max(0, min(x[1], y[1]) - max(x[0], y[0])) for x in a[k] for y in d[k]) for k in a}
    got = {x.media_id: x.shared for x in O.overlap(frame(a), frame(d), I.KEY).collect()}
    assert got == {k: v for k, v in shared.items() if v}
    size = lambda s: sum(y - x for x, y in s)
    assert {x.media_id: x.loss for x in O.loss(frame(a), frame(d)).collect()} == {k: size(a[k]) + size(d[k]) - 2 * shared[k] for k in d if d[k]}
    assert {x.media_id: x.mismatch for x in O.count_mismatch(frame(a), frame(d)).collect()} == {k: abs(len(a[k]) - len(d[k])) for k in a if a[k] or d[k]}
    joined = O.coalesced(spark.createDataFrame([(1, "c", "t", 0.0, 5.0), (1, "c", "t", 1.0, 2.0), (1, "c", "t", 5.0, 6.0), (1, "c", "t", 8.0, 9.0)], "media_id long, category string, tag string, start double, end double"))
    assert sorted((x.start, x.end) for x in joined.collect()) == [(0.0, 6.0), (8.0, 9.0)]


def test_grid_search_matches_one_by_one(spark):
    r = random.Random(6)
    spans = spark.createDataFrame([(k, "c", "t", *s) for k in range(6) for s in random_spans(r, 15)], SPAN)
    buckets = I.adjacency_buckets(spans, F.lit(2.0)).cache()
    wanted = spark.createDataFrame([(k, "c", "t", 4.0 * k, 4.0 * k + 30) for k in range(6)], "media_id long, category string, tag string, start double, end double")
    choices = {"density_weight": [0.04], "gap_factor": [0.5, 0.85], "average_factor": [0.25], "min_gap": [0.0, 4.0]}
    got = O.grid_search(buckets, wanted, O.parameter_grid(spark, **choices), 6.0).collect()
    assert len(got) == 4 and [g.loss for g in got] == sorted(g.loss for g in got)
    for g in got:
        p = {n: g[n] for n in choices}
        actual = I.keep_long(I.merge_buckets(buckets, params=p), F.lit(6.0))
        loss = O.loss(actual, wanted).agg(F.sum("loss")).first()[0]
        assert g.loss == pytest.approx(loss + 2 * abs(actual.count() - wanted.count()))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 60), unique=True, max_size=25), st.integers(1, 5))
def test_partitioning_does_not_matter(spark, frames, parts):
    det = spark.createDataFrame([(1, "c", "t", float(f), None) for f in frames], DET)
    got = sorted((x.start, x.end) for x in I.run_lengths(det.repartition(parts), F.lit(1.0), 1.0).collect())
    assert got == [(a, b) for a, b, _ in runs([(float(f), None) for f in sorted(frames)], 1.0, 1.0)]
    assert all(x[1] is None or x[1] > x[0] for x in got)
