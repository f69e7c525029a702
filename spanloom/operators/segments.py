"""Density clustering of keys of any length, and its parameter search, over segments that cannot influence one another.

A gap between two buckets stays what it is through all passes: survivors on either side begin and end in original
buckets.  In pass k a survivor is made of at most 2^(k-1) buckets, and only of ones that earlier passes could join, so the largest
weight that may stand at a gap in each pass is known without merging anything.  Where no pass can bridge the gap the key
is cut: both sides are segments, which tasks work on by themselves.  A cut depends on at most 1,023 buckets either way, so
keys are cut as streams; segments go through the passes many at a time, as flat arrays, in time linear in their buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import CLUSTER, KEY, PASSES

#: Buckets on either side of a gap that its passes can draw on.
HALO = (1 << PASSES) - 1
#: Buckets handed to the passes at once, whole segments always.
CHUNK_ROWS = 50_000


class Pending:
    """Sorted buckets of many segments as flat arrays: starts, ends, weights, intervals, segment numbers.

    firsts and lasts are further arrays, of which a merged bucket keeps its first and its last bucket's value.
    """

    def __init__(self, s, e, tc, fi, group, firsts=(), lasts=()):
        self.s, self.e, self.tc, self.fi, self.group, self.firsts, self.lasts = s, e, tc, fi, group, firsts, lasts

    def merged(self, p: dict) -> Pending:
        """After one greedy pass from the left; self if nothing merges.  The arithmetic order is part of the result."""
        s, e, tc, fi = self.s, self.e, self.tc, self.fi
        d = e - s + fi
        w = d * (1 + p["density_weight"] * (tc / d))
        a, b = w[:-1], w[1:]
        near = (s[1:] - e[:-1] - fi[:-1]) <= p["min_gap"] + (np.minimum(a, b) + np.abs(a - b) * p["average_factor"]) * p["gap_factor"]
        near &= self.group[1:] == self.group[:-1]
        if not near.any():
            return self
        # of a run of pairs that would merge, every second one does: the first, the third, ...
        at = np.arange(len(near))
        refused = np.maximum.accumulate(np.where(near, -1, at))
        head = np.flatnonzero(near & ((at - refused) % 2 == 1))
        keep = np.ones(len(s), bool)
        keep[head + 1] = False

        def last(values):
            values = values.copy()
            values[head] = values[head + 1]
            return values[keep]

        tc = tc.copy()
        tc[head] += tc[head + 1]
        return Pending(s[keep], last(e), tc[keep], fi[keep], self.group[keep], tuple(v[keep] for v in self.firsts), tuple(map(last, self.lasts)))

    def after_passes(self, p: dict) -> Pending:
        now = self
        for _ in range(PASSES):
            new = now.merged(p)
            if new is now:
                break  # a pass that merges nothing is followed by others that do not
            now = new
        return now


def bridgeable(s, e, tc, fi, same, p: dict) -> np.ndarray:
    """Whether any pass may merge across each gap, for sorted buckets and ``same`` (both sides of one key): never a false no.

    The test's right side grows with both weights if average_factor is within 0..1 and the other parameters are not
    negative; otherwise every gap may be bridged.
    """
    if not (0 <= p["average_factor"] <= 1 and p["gap_factor"] >= 0 and p["density_weight"] >= 0):
        return same.copy()
    n, at = len(s), np.arange(len(s))
    gap, held = s[1:] - e[:-1] - fi[:-1], np.zeros(n + 1)
    np.cumsum(np.maximum(np.nan_to_num(tc), 0), out=held[1:])
    joined = np.zeros(max(0, n - 1), bool)
    for k in range(PASSES):
        reach = 1 << k
        first = np.maximum.accumulate(np.where(np.r_[True, ~joined], at, 0))
        last = np.minimum.accumulate(np.where(np.r_[~joined, True], at, n)[::-1])[::-1]
        i, j = np.maximum(first, at - reach + 1)[:-1], np.minimum(last, at + reach - 1)[1:]
        left = e[:-1] - s[i] + fi[:-1] + p["density_weight"] * (held[1:-1] - held[i])
        right = e[j] - s[1:] + fi[:-1] + p["density_weight"] * (held[j + 1] - held[1:-1])
        pull = np.minimum(left, right) + np.abs(left - right) * p["average_factor"]
        more = same & (gap <= (p["min_gap"] + pull * p["gap_factor"]) * (1 + 1e-9) + 1e-6)
        if (more <= joined).all() and (last - first).max(initial=0) < reach:
            break  # neither longer survivors nor other gaps can come
        joined |= more
    return joined


def _same(t: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether each row but the first has the values of the row before."""
    same = np.ones(max(0, t.num_rows - 1), bool)
    for c in columns:
        codes = t.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        same &= codes[1:] == codes[:-1]
    return same


def _cut(batches: Iterator[pa.RecordBatch], p: dict) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in order of key and start to (rows, whether each begins a segment), holding a chunk and its surroundings."""
    held, sent, rows = [], 0, 0  # the first ``sent`` rows held are only there to be looked back on

    def flags(t: pa.Table) -> np.ndarray:
        joined = bridgeable(*(t.column(c).to_numpy() for c in ("s", "e", "tc", "fi")), _same(t, KEY), p)
        return np.r_[True, ~joined]

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows - sent > CHUNK_ROWS + HALO:
            t = pa.Table.from_batches(held)
            until = rows - HALO - 1
            yield t.slice(sent, until - sent), flags(t)[sent:until]
            keep = max(0, until - HALO - 1)
            held, sent, rows = t.slice(keep).to_batches(), until - keep, rows - keep
    if rows > sent:
        t = pa.Table.from_batches(held)
        yield t.slice(sent), flags(t)[sent:]


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """As ``_cut``, of rows in order of key and known segment."""
    before = None
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches(([before] if before is not None else []) + [b])
            same = _same(t, [*KEY, "segment"])
            yield pa.Table.from_batches([b]), ~same if before is not None else np.r_[True, ~same]
            before = b.slice(b.num_rows - 1)


def _chunks(stream: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, segment numbers) of whole segments, some ``CHUNK_ROWS`` at a time."""
    tables, flags, rows = [], [], 0
    for t, f in stream:
        tables.append(t)
        flags.append(f)
        rows += len(f)
        starts = np.flatnonzero(f)
        if rows < CHUNK_ROWS or not len(starts):
            continue
        cut = rows - len(f) + int(starts[-1])  # the last segment may go on
        whole, begins = pa.concat_tables(tables), np.concatenate(flags)
        if cut:
            yield whole.slice(0, cut), np.cumsum(begins[:cut])
            tables, flags, rows = [whole.slice(cut)], [begins[cut:]], rows - cut
    if rows:
        yield pa.concat_tables(tables), np.cumsum(np.concatenate(flags))


def _flat(t: pa.Table, group: np.ndarray, firsts=(), lasts=()) -> Pending:
    return Pending(*(t.column(c).to_numpy() for c in ("s", "e", "tc", "fi")), group, firsts, lasts)


def _ordered(buckets: DataFrame, *more: str) -> DataFrame:
    """Whole keys in a task each, buckets by start: what numbering them by a window does, on the partitioning they may have already."""
    rows = buckets.select(*KEY, "s", "e", "tc", F.col("fi").cast("double").alias("fi"), *more)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("s"))).sortWithinPartitions(*KEY, "s")


def with_segments(buckets: DataFrame, p: dict, *more: str) -> DataFrame:
    """KEY, s, e, tc, fi, ``more`` columns, place (in the key) and segment: a number that is unique within the key."""
    rows = _ordered(buckets, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for t, begins in _cut(batches, p):
            numbers = number + np.cumsum(begins)
            number = int(numbers[-1])
            yield from t.append_column("segment", pa.array(numbers)).to_batches()

    return rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in rows.dtypes) + ", segment long")


def _segments(buckets: DataFrame, p: dict, tasks: int | None, *more: str):
    """Rows, and the function that reads whole segments from them: dealt over ``tasks`` by segment, or where their keys are."""
    if tasks:
        rows = with_segments(buckets, p, *more).repartition(tasks, *KEY, "segment").sortWithinPartitions(*KEY, "segment", "s")
        return rows, lambda batches: _chunks(_given(batches))
    return _ordered(buckets, *more), lambda batches: _chunks(_cut(batches, p))


def merge_buckets_segmented(buckets: DataFrame, params: dict | None = None, tasks: int | None = None) -> DataFrame:
    """O-53 stage 2, linear in a key's buckets; with ``tasks`` a key's segments are dealt over that many tasks.

    Same rows as ``intervals.merge_buckets``.  A task holds a chunk of segments, or one segment where that is longer.
    """
    p, kinds = CLUSTER | (params or {}), dict(buckets.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in KEY) + ", fi double, s double, e double, tc double"
    rows, read = _segments(buckets, p, tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in read(batches):
            done = _flat(t, group, firsts=(np.arange(t.num_rows),)).after_passes(p)
            out = t.select(KEY).take(pa.array(done.firsts[0]))
            for name in ("fi", "s", "e", "tc"):
                out = out.append_column(name, pa.array(getattr(done, name)))
            yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def searched(buckets: DataFrame, grid: list[dict], least: float, tasks: int) -> DataFrame:
    """(combo, n, covered, shared) summed over all keys, for buckets with cover_s, cover_e and wanted.

    cover_s, cover_e: seconds that the key's desired intervals cover before the bucket's start and end; a merged interval's
    overlap is what its last bucket's end has more than its first one's start, so it costs nothing to search.
    wanted: whether the key has desired intervals.  n counts the merged intervals of every key, covered those of wanted keys.
    What leaves a task is one row for each combination, whatever the number of keys.
    """
    many = [CLUSTER | g for g in grid]
    widest = {n: max(g[n] for g in many) for n in CLUSTER} if many else CLUSTER
    if any(g["average_factor"] < 0 or g["gap_factor"] < 0 or g["density_weight"] < 0 for g in many):
        widest["gap_factor"] = -1.0  # no bound holds: keys stay whole
    rows, read = _segments(buckets, widest, tasks, "cover_s", "cover_e", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, covered, shared = np.zeros(len(many), np.int64), np.zeros(len(many)), np.zeros(len(many))
        for t, group in read(batches):
            before, until, wanted = (t.column(c).to_numpy(zero_copy_only=False) for c in ("cover_s", "cover_e", "wanted"))
            flat = _flat(t, group, (before, wanted.astype(float)), (until,))
            for k, p in enumerate(many):
                done = flat.after_passes(p)
                long = done.e - done.s + done.fi >= least
                n[k] += np.count_nonzero(long)
                covered[k] += ((done.e - done.s) * done.firsts[1])[long].sum()
                shared[k] += (done.lasts[0] - done.firsts[0])[long].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(many), dtype=np.int32)), *map(pa.array, (n, covered, shared))], ["combo", "n", "covered", "shared"])

    found = rows.mapInArrow(run, "combo int, n long, covered double, shared double")
    return found.groupBy("combo").agg(*(F.sum(c).alias(c) for c in ("n", "covered", "shared")))


def merge_proportional_streamed(spans: DataFrame, interval: str, proportion: float = 0.5) -> DataFrame:
    """O-54 as ``intervals.merge_proportional``, linear in a key's spans: one pass over keys in order, holding one interval.

    What an interval may bridge grows with it, so its spans are taken one after the other; a task holds a batch.
    """
    key = Window.partitionBy(*KEY)
    pos = F.coalesce("end", "start").alias("p")
    rows = spans.select(*KEY, F.col("start").alias("s"), F.col("end").alias("e"), pos, "max_gap", F.col("min_marker_duration").alias("least"), F.expr(interval).cast("double").alias("fi"))
    rows = rows.withColumns({c: F.max(c).over(key) for c in ("max_gap", "least", "fi")}).sortWithinPartitions(*KEY, "s", "e", "p")
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = held = None  # the last row, and the interval so far: its key's values, start, end or None, position, least

        def kept() -> bool:
            return held is not None and held[2] is not None and held[2] - held[1] >= held[4]

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches(([before] if before is not None else []) + [b])
            same = [*([False] if before is None else []), *_same(t, KEY).tolist()]
            keys, out = list(zip(*(b.column(c).to_pylist() for c in KEY))), []
            for i, (s, e, p, most, least, fi) in enumerate(zip(*(b.column(c).to_pylist() for c in ("s", "e", "p", "max_gap", "least", "fi")))):
                if same[i]:
                    gap = s - held[3] - fi
                    if gap <= most or gap <= proportion * ((held[2] - held[1]) if held[2] is not None else 0.0):
                        held = (held[0], held[1], p, p, least)
                        continue
                if kept():
                    out.append((*held[0], held[1], held[2]))
                held = (keys[i], s, e, p, least)
            before = b.slice(b.num_rows - 1)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names)
        if kept():
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*held[0], held[1], held[2]), types)], names)

    names = [*KEY, "start", "end"]
    types = [*(f.type for f in _arrow_schema(rows) if f.name in KEY), pa.float64(), pa.float64()]
    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in KEY) + ", start double, end double")


def _arrow_schema(rows: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(rows.schema)
