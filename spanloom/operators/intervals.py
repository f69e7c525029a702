"""Intervals from time-coded detections: runs, gap merging, density clustering, totals and tags.

All work within (media_id, category, tag), so one hash exchange on that key serves a whole chain.  No Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import small

KEY = ["media_id", "category", "tag"]
PASSES = 10
CLUSTER = {"density_weight": 0.04, "gap_factor": 0.85, "average_factor": 0.25, "min_gap": 0.0}


def _by(order: str) -> Window:
    return Window.partitionBy(*KEY).orderBy(order)


def _islands(frame: DataFrame, order: str, joined: Column) -> DataFrame:
    """``frame`` with an island number: a row opens a new one unless ``joined`` to the row before."""
    opens = F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)
    return frame.withColumn("_new", opens).withColumn("island", F.sum("_new").over(_by(order)))


def run_lengths(detections: DataFrame, interval: Column, max_merge: float = 0.0) -> DataFrame:
    """O-51: runs of detections with equal confidence (null equals null) and gaps of at most ``max_merge``.

    end is null for a run of one frame.
    """
    w = _by("frame_index")
    gap = F.col("frame_index") - F.lag("frame_index").over(w) - interval
    same = F.col("confidence").eqNullSafe(F.lag("confidence").over(w))
    rows = _islands(detections, "frame_index", (gap <= max_merge) & same & F.lag("frame_index").over(w).isNotNull())
    return rows.groupBy(*KEY, "island").agg(
        F.min("frame_index").alias("start"),
        F.when(F.count("*") > 1, F.max("frame_index")).alias("end"),
        F.min("confidence").alias("confidence"),
    ).drop("island")


def with_rules(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """O-47, O-64: spans of configured tags that reach the tag's threshold (inclusive) and may have markers.

    rules are resolved: category, tag, display, min_marker_duration, max_gap, required_duration, tag_threshold.
    A null confidence does not pass here.
    """
    return spans.join(small(rules), ["category", "tag"]).where("confidence >= tag_threshold and min_marker_duration > 0")


def with_interval(spans: DataFrame, metadata: DataFrame) -> DataFrame:
    """O-65: spans with their category's frame_interval from metadata(media_id, category, frame_interval).

    Evaluation fails, naming the category, where there is none.
    """
    known = metadata.select("media_id", "category", "frame_interval")
    message = F.concat_ws(" ", F.lit("no frame interval is known for category"), F.col("category"))
    return spans.join(known, ["media_id", "category"], "left").withColumn("frame_interval", F.coalesce("frame_interval", F.raise_error(message).cast("double")))


def with_position(spans: DataFrame) -> DataFrame:
    return spans.withColumn("pos", F.coalesce("end", "start"))


def merge_gaps(spans: DataFrame, interval: Column) -> DataFrame:
    """O-52: merge while the gap is at most max_gap; keep intervals of min_marker_duration, without the last frame."""
    w = _by("start")
    rows = with_position(spans)
    rows = _islands(rows, "start", F.col("start") - F.lag("pos").over(w) - interval <= F.col("max_gap"))
    rows = rows.groupBy(*KEY, "island").agg(
        F.min("start").alias("start"),
        F.when(F.count("*") > 1, F.max_by("pos", "start")).otherwise(F.max("end")).alias("end"),
        F.max("min_marker_duration").alias("least"),
    )
    return rows.where(F.expr("end is not null and end - start >= least")).drop("island", "least")


def adjacency_buckets(spans: DataFrame, interval: Column) -> DataFrame:
    """O-53 stage 1: spans that touch exactly; tc weighs each by the whole bucket up to it."""
    w = _by("start")
    rows = with_position(spans).withColumn("_fi", interval)
    rows = _islands(rows, "start", F.col("start") - F.lag("pos").over(w) == F.col("_fi"))
    first = F.min("start").over(Window.partitionBy(*KEY, "island"))
    rows = rows.withColumn("_w", F.col("confidence") * (F.col("pos") - first + F.col("_fi")))
    return rows.groupBy(*KEY, "island").agg(F.min("start").alias("s"), F.max("pos").alias("e"), F.sum("_w").alias("tc"), F.max("_fi").alias("fi")).drop("island")


def _merges(a_s, a_e, a_tc, b_s, b_e, b_tc, fi, p: dict) -> str:
    """SQL of the pair test; the arithmetic order is part of the result."""
    da, db = f"({a_e} - {a_s} + {fi})", f"({b_e} - {b_s} + {fi})"
    wa, wb = (f"({d} * (1 + {p['density_weight']} * ({tc} / {d})))" for d, tc in ((da, a_tc), (db, b_tc)))
    return f"({b_s} - {a_e} - {fi}) <= {p['min_gap']} + (least({wa}, {wb}) + abs({wa} - {wb}) * {p['average_factor']}) * {p['gap_factor']}"


def _fold(array: str, fi: str, p: dict) -> str:
    """SQL: ``PASSES`` greedy passes over an array of struct<s, e, tc>, as folds with one pending bucket."""
    item = "struct<s: double, e: double, tc: double>"
    zero = f"named_struct('done', cast(array() as array<{item}>), 'held', cast(null as {item}))"
    test = _merges("st.held.s", "st.held.e", "st.held.tc", "x.s", "x.e", "x.tc", fi, p)
    step = (
        f"if(st.held is null, named_struct('done', st.done, 'held', x), if({test}, "
        f"named_struct('done', st.done || array(named_struct('s', st.held.s, 'e', x.e, 'tc', st.held.tc + x.tc)), 'held', cast(null as {item})), "
        "named_struct('done', st.done || array(st.held), 'held', x)))"
    )
    one = f"aggregate(acc, {zero}, (st, x) -> {step}, st -> if(st.held is null, st.done, st.done || array(st.held)))"
    return f"aggregate(sequence(1, {PASSES}), {array}, (acc, i) -> {one})"


def merge_buckets(buckets: DataFrame, params: dict | None = None) -> DataFrame:
    """O-53 stage 2 as folds over each key's sorted buckets, a row of arrays each: no Python, for keys of some thousand buckets.

    For longer ones, and parameter searches, there is ``segments``; ``merge_buckets_windowed`` needs no Python either.
    """
    p = CLUSTER | (params or {})
    rows = buckets.groupBy(*KEY).agg(F.max("fi").alias("fi"), F.sort_array(F.collect_list(F.struct("s", "e", "tc"))).alias("b"))
    return rows.select(*KEY, "fi", F.inline(F.expr(_fold("b", "fi", p))))


def merge_buckets_windowed(buckets: DataFrame, params: dict | None = None) -> DataFrame:
    """O-53 stage 2 as window passes: linear in a key's buckets, for tags with more than some ten thousand."""
    p, w = CLUSTER | (params or {}), _by("s")
    rows = buckets
    for _ in range(PASSES):
        lead = {c: F.lead(c).over(w) for c in ("s", "e", "tc")}
        rows = rows.withColumns({f"n_{c}": x for c, x in lead.items()}).withColumn("rn", F.row_number().over(w))
        rows = rows.withColumn("m", F.coalesce(F.expr(_merges("s", "e", "tc", "n_s", "n_e", "n_tc", "fi", p)), F.lit(False)))
        last = F.max(F.when(~F.col("m"), F.col("rn"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("head", F.col("m") & ((F.col("rn") - 1 - F.coalesce(last, F.lit(0))) % 2 == 0))
        rows = rows.withColumn("gone", F.coalesce(F.lag("head").over(w), F.lit(False))).where("not gone")
        rows = rows.select(*KEY, "fi", "s", F.when(F.col("head"), F.col("n_e")).otherwise(F.col("e")).alias("e"), F.when(F.col("head"), F.col("tc") + F.col("n_tc")).otherwise(F.col("tc")).alias("tc"))
    return rows


def keep_long(merged: DataFrame, least: Column) -> DataFrame:
    """O-53 stage 3: intervals of the least duration, the last frame included."""
    return merged.where(F.col("e") - F.col("s") + F.col("fi") >= least).select(*[c for c in merged.columns if c not in ("s", "e", "tc", "fi")], F.col("s").alias("start"), F.col("e").alias("end"), F.col("tc").alias("total_confidence"))


def merge_proportional(spans: DataFrame, interval: str, proportion: float = 0.5) -> DataFrame:
    """O-54: as O-52, but also merging gaps up to a proportion of the interval so far: a left fold."""
    item = "struct<s: double, e: double, p: double>"
    rows = with_position(spans).groupBy(*KEY).agg(
        F.max("max_gap").alias("max_gap"), F.max("min_marker_duration").alias("least"), F.expr(f"max({interval})").alias("fi"),
        F.sort_array(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("pos").alias("p")))).alias("b"),
    )
    gap = "(x.s - st.held.p - fi)"
    test = f"({gap} <= max_gap or {gap} <= {proportion}D * coalesce(st.held.e - st.held.s, 0D))"
    grown = "named_struct('s', st.held.s, 'e', x.p, 'p', x.p)"
    step = f"if(st.held is null, named_struct('done', st.done, 'held', x), if({test}, named_struct('done', st.done, 'held', {grown}), named_struct('done', st.done || array(st.held), 'held', x)))"
    fold = f"aggregate(b, named_struct('done', cast(array() as array<{item}>), 'held', cast(null as {item})), (st, x) -> {step}, st -> st.done || array(st.held))"
    out = rows.select(*KEY, "least", F.inline(F.expr(fold))).where("e is not null and e - s >= least")
    return out.select(*KEY, F.col("s").alias("start"), F.col("e").alias("end"))


def totals(spans: DataFrame, rules: DataFrame, interval: Column, media: DataFrame) -> DataFrame:
    """O-55: seconds of every configured tag of every media, zeros included; a null or zero confidence passes.

    The zeros make media x rules rows, so the cross join is the result's own size; the rules are configuration.
    """
    passes = F.coalesce(F.col("confidence"), F.lit(0.0)).isin(0.0) | (F.col("confidence") >= F.col("tag_threshold"))
    held = F.when(passes, F.when(F.col("end").isNull(), interval).otherwise(F.col("end") - F.col("start") + interval))
    rules = small(rules)
    sums = spans.join(rules, ["category", "tag"]).groupBy(*KEY).agg(F.coalesce(F.sum(held), F.lit(0.0)).alias("total"))
    every = media.select("media_id").join(rules)
    return every.join(sums, KEY, "left").select(*KEY, "display", "required_duration", F.coalesce("total", F.lit(0.0)).alias("total"))


def assigned_tags(sums: DataFrame) -> DataFrame:
    """O-55, O-77: display tags whose total reaches a required duration above 0."""
    return sums.where("required_duration > 0 and total >= required_duration").select("media_id", "category", F.col("display").alias("video_tag")).distinct()
