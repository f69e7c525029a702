"""Hard negatives by angular triangle filtering.

Every row stores its angles to a few reference directions.  With angle s from an anchor to a reference and t from a row
to it, the angle between the two lies between |s - t| and min(s + t, 2 pi - s - t); its cosine times both norms bounds the
score, rounded outwards.  Only rows whose bounds overlap the wanted window of scores are scored, exactly, in integers.

The anchors meet all rows in blocks: a task takes one block of anchors and one share of the row blocks, as a stream, and
keeps each anchor's best so far, which narrows its window.  Two passes: the positives of every anchor, then the negatives
in the windows that the positives' scores set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

#: Rows in a block, anchors in a block, reference directions, references that an anchor is held against.
BLOCK_ROWS, ANCHOR_ROWS, REFERENCES, NEAREST = 2048, 512, 16, 3
#: Rows from which the reference directions are chosen (those of the smallest hashes).  They steer work, not results.
SAMPLE_ROWS = 2048
#: What angles may be off by: they are stored as 32-bit floats, and arccos is steep near 1.
SLACK = 4e-6
#: Integers up to this are exact in doubles, and so are sums that stay below it.
EXACT = 2.0**53


def quantised(vectors: list[np.ndarray], scale: float) -> np.ndarray:
    """floor(scale * component) as doubles, n x the longest length; shorter vectors have zeros there."""
    q = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)))
    for i, v in enumerate(vectors):
        q[i, : len(v)] = np.floor(scale * v)
    return q


def reference_directions(sample: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors (count x dims at most): centres of the densest parts of ``sample`` first, then what lies farthest from them."""
    norm = np.linalg.norm(sample, axis=1)
    x = sample[norm > 0] / norm[norm > 0][:, None]
    if not len(x):
        return np.zeros((0, sample.shape[1]))
    near = x @ x.T
    close = near > np.cos(np.pi / 9)
    free, chosen = np.ones(len(x), bool), []
    while len(chosen) < min(count, len(x)):
        crowd = (close & free).sum(1) * free
        # a crowd is more than one row; without one, the row least like all references so far
        i = int(crowd.argmax()) if crowd.max() > max(1, len(x) // 200) or not chosen else int(near[:, chosen].max(1).argmin())
        chosen.append(i)
        free &= ~close[i]
    return x[chosen]


def _angles(q: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms and angles to the references; a zero vector's angles are 0 and its scores are bounded by its norm."""
    norm = np.sqrt((q * q).sum(1))
    dims = max(q.shape[1], refs.shape[1])
    wide = lambda m: np.pad(m, ((0, 0), (0, dims - m.shape[1])))
    cosine = (wide(q) @ wide(refs).T) / np.where(norm > 0, norm, 1)[:, None]
    return norm, np.arccos(np.clip(np.where(norm[:, None] > 0, cosine, 1.0), -1, 1)).astype(np.float32)


class Rows:
    """A block of rows: ids, labels, scaled vectors, norms, angles."""

    def __init__(self, ids, labels, q, norm, angles):
        self.ids, self.labels, self.q, self.norm, self.angles = ids, labels, q, norm, angles
        self.largest = float(np.abs(q).max(initial=0))

    def cells(self) -> list[bytes | int]:
        q = self.q.astype(np.int32 if self.largest < 1 << 31 else float)
        parts = (self.ids.astype(np.int64), self.labels.astype(np.int64), q, self.norm.astype(float), self.angles.astype(np.float32))
        return [p.tobytes() for p in parts] + [self.q.shape[1]]

    @classmethod
    def read(cls, r: dict) -> Rows:
        kinds = (("vec_ids", np.int64), ("labels", np.int64), ("norms", float), ("angles", np.float32))
        ids, labels, norm, angles = (np.frombuffer(r[n], t) for n, t in kinds)
        q = np.frombuffer(r["q"], np.int32 if len(r["q"]) == 4 * len(ids) * r["width"] else float).astype(float)
        return cls(ids, labels, q.reshape(len(ids), r["width"]), norm, angles.reshape(len(ids), -1) if len(angles) else np.zeros((len(ids), 0)))

    def scores(self, i: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """Exact inner products of rows ``i`` with ``vector``."""
        w = min(self.q.shape[1], len(vector))
        bound = self.largest * float(np.abs(vector).max(initial=0)) * max(w, 1)
        if bound < EXACT:
            return (self.q[i, :w] @ vector[:w]).astype(np.int64)
        whole = [int(v) for v in vector[:w]]
        found = [sum(int(a) * b for a, b in zip(row, whole)) for row in self.q[i, :w]]
        if max(map(abs, found), default=0) >= 1 << 63:
            raise ValueError("a score does not fit 64 bits")
        return np.array(found, np.int64)

    def bounds(self, anchor: Rows, a: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible score of every row with anchor ``a``, rounded outwards."""
        top = self.norm * anchor.norm[a]
        if not self.angles.shape[1] or not anchor.norm[a]:
            return -top, top
        near = np.argsort(anchor.angles[a])[:NEAREST]
        s, t = anchor.angles[a][near].astype(float), self.angles[:, near].astype(float)
        least = np.maximum(np.abs(t - s).max(1) - SLACK, 0.0)
        both = t + s
        most = np.minimum(np.minimum(both, 2 * np.pi - both).min(1) + SLACK, np.pi)
        slack = top * 1e-9 + 1e-6
        return top * np.cos(most) - slack, top * np.cos(least) + slack


ROWS = "vec_ids binary, labels binary, q binary, norms binary, angles binary, width int"


def _packed(t: pa.Table, refs: np.ndarray, scale: float) -> pa.RecordBatch:
    q = quantised([np.asarray(v.as_py(), float) for v in t.column("embedding")], scale)
    cells = Rows(t.column("vec_id").to_numpy(), t.column("label").to_numpy(), q, *_angles(q, refs)).cells()
    types = [*[pa.binary()] * 5, pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([v], x) for v, x in zip(cells, types)], ["vec_ids", "labels", "q", "norms", "angles", "width"])


def packed_anchors(anchors: DataFrame, refs: np.ndarray, scale: float) -> DataFrame:
    """(vec_id, label, embedding) to blocks of some ``ANCHOR_ROWS``, dealt by a hash of the row."""
    count = -(-anchors.count() // ANCHOR_ROWS)
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(max(1, count))))

    def pack(t: pa.Table) -> pa.Table:
        rows = pa.Table.from_batches([_packed(t, refs, scale)])
        return rows.append_column("block", t.column("block").slice(0, 1))

    return dealt.groupBy("block").applyInArrow(pack, ROWS + ", block long")


def packed_rows(vectors: DataFrame, refs: np.ndarray, scale: float) -> DataFrame:
    """(vec_id, label, embedding) to blocks of ``BLOCK_ROWS``, ordered by nearest reference and the angle to it.

    So a block's rows have like angles and one near copy's fate is its neighbours'.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = quantised([np.asarray(v.as_py(), float) for v in b.column("embedding")], scale)
                _, angles = _angles(q, refs)
                ref = angles.argmin(1) if len(refs) else np.zeros(len(q), int)
                angle = angles[np.arange(len(q)), ref] if len(refs) else np.zeros(len(q))
                columns = [pa.array(ref.astype(np.int32)), pa.array(angle.astype(float)), *(b.column(n) for n in ("vec_id", "label", "embedding"))]
                yield pa.RecordBatch.from_arrays(columns, ["ref", "angle", "vec_id", "label", "embedding"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= BLOCK_ROWS:
                yield _packed(held.slice(0, BLOCK_ROWS), refs, scale)
                held = held.slice(BLOCK_ROWS)
        if held is not None and held.num_rows:
            yield _packed(held, refs, scale)

    rows = vectors.mapInArrow(measured, "ref int, angle double, vec_id long, label long, embedding array<double>")
    keys = ["ref", "angle", "vec_id"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("vec_id", "label", "embedding")
    return rows.mapInArrow(cut, ROWS).withColumn("block", F.monotonically_increasing_id())


def meetings(anchors: DataFrame, rows: DataFrame, shares: int, work: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``work`` on each (anchor block, share of the row blocks): the anchor block's row first, then row blocks, streamed.

    An anchor block goes to ``shares`` tasks and a row block to every anchor block: blocks meet, rows do not.
    """
    count = anchors.agg(F.max("block")).first()[0]
    each = F.sequence(F.lit(0), F.lit(-1 if count is None else count).cast("long")) if count is not None else F.expr("array()").cast("array<long>")
    mine = anchors.withColumn("kind", F.lit(0)).withColumn("anchor_block", F.col("block")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    other = rows.withColumn("kind", F.lit(1)).withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int")).withColumn("anchor_block", F.explode(each))
    if "windows" in anchors.columns:
        other = other.withColumn("windows", F.lit(None).cast(dict(anchors.dtypes)["windows"]))
    both = mine.unionByName(other)
    tasks = both.repartition(int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "anchor_block", "share")
    return tasks.sortWithinPartitions("anchor_block", "share", "kind").mapInArrow(work, schema)


def _streams(batches: Iterator[pa.RecordBatch], start: Callable, meet: Callable, finish: Callable) -> Iterator[pa.RecordBatch]:
    """Calls start(anchor row), meet(state, Rows), finish(state) for each task's run of blocks."""
    state, place = None, None
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            if (r["anchor_block"], r["share"]) != place:
                if state is not None:
                    yield finish(state)
                place, state = (r["anchor_block"], r["share"]), start(r) if r["kind"] == 0 else None
            elif state is not None:  # a number without anchors has rows alone
                meet(state, Rows.read(r))
    if state is not None:
        yield finish(state)


def _best(score: np.ndarray, ids: np.ndarray, held: tuple[np.ndarray, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` highest of the new and the held, ties by smaller id."""
    s, v = np.concatenate([held[0], score]), np.concatenate([held[1], ids])
    if len(s) > 4 * most:  # only those that reach the most-th score can be among the first
        edge = np.partition(s, len(s) - most)[len(s) - most]
        s, v = s[s >= edge], v[s >= edge]
    order = np.lexsort((v, -s))[:most]
    return s[order], v[order]


NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def positive_work(most: int) -> Callable[[Iterator], Iterator]:
    """Each anchor's ``most`` best other rows of its label in a task's share."""

    def start(r):
        anchors = Rows.read(r)
        return r["anchor_block"], anchors, [NONE] * len(anchors.ids)

    def meet(state, rows):
        _, anchors, held = state
        for a in range(len(anchors.ids)):
            left = (rows.labels == anchors.labels[a]) & (rows.ids != anchors.ids[a])
            if len(held[a][0]) == most:
                left &= rows.bounds(anchors, a)[1] >= held[a][0][-1]
            i = np.flatnonzero(left)
            if len(i):
                held[a] = _best(rows.scores(i, anchors.q[a]), rows.ids[i], held[a], most)

    def finish(state):
        block, anchors, held = state
        rows = [(block, a, int(anchors.ids[a]), int(v), int(s)) for a in range(len(held)) for s, v in zip(*held[a])]
        return _batch(rows, ("anchor_block", "a", "anchor_id", "positive_id", "positive_score"))

    return lambda batches: _streams(batches, start, meet, finish)


def negative_work(most: int, low: int, high: int) -> Callable[[Iterator], Iterator]:
    """The ``most`` best rows of other labels in each (anchor, positive)'s window, in a task's share."""

    def start(r):
        anchors = Rows.read(r)
        windows = [[] for _ in anchors.ids]
        for w in r["windows"]:
            p = w["positive_score"]
            # low * p <= 100 * n <= high * p in integers
            windows[w["a"]].append([w["rank"], w["positive_id"], p, -(-low * p // 100), high * p // 100, NONE])
        return r["anchor_block"], anchors, windows

    def meet(state, rows):
        _, anchors, windows = state
        for a, open_ in enumerate(windows):
            open_ = [w for w in open_ if w[3] <= w[4]]
            if not open_:
                continue
            least = min(w[5][0][-1] if len(w[5][0]) == most else w[3] for w in open_)
            lower, upper = rows.bounds(anchors, a)
            i = np.flatnonzero((rows.labels != anchors.labels[a]) & (upper >= least) & (lower <= max(w[4] for w in open_)))
            if not len(i):
                continue
            score = rows.scores(i, anchors.q[a])
            for w in open_:
                edge = w[5][0][-1] if len(w[5][0]) == most else w[3]
                fits = np.flatnonzero((score >= edge) & (score <= w[4]))
                if len(fits):
                    w[5] = _best(score[fits], rows.ids[i[fits]], w[5], most)

    def finish(state):
        block, anchors, windows = state
        rows = [
            (block, a, int(anchors.ids[a]), rank, pid, p, int(v), int(s))
            for a, open_ in enumerate(windows) for rank, pid, p, _, _, found in open_ for s, v in zip(*found)
        ]
        return _batch(rows, ("anchor_block", "a", "anchor_id", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score"))

    return lambda batches: _streams(batches, start, meet, finish)


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], list(names))


def _longs(names: str) -> str:
    return ", ".join(f"{n} long" for n in names.split())


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0
) -> DataFrame:
    """(vec_id, label, embedding) to anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by ``every``; a score is the inner product of floor(scale * component).
    For each anchor and each of its first ``positives`` other rows of its label, the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score; higher scores first, ties by smaller vec_id.

    Rows without label, vector or vec_id and those with a null or non-finite component take no part.  A vector that is
    shorter than another counts as zero beyond its end.  Rows are "other" if their vec_id differs; repeated rows take a place
    each, as positives and negatives, but repeated anchors count once.  A negative positive_score has no window.  No anchors, or an empty
    table, give no rows.  Other columns are ignored.  Scores that do not fit 64 bits are an error.
    """
    spark = vectors.sparkSession
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))

    sample = kept.select("embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLE_ROWS).collect()
    refs = reference_directions(quantised([np.asarray(r[0], float) for r in sample], scale))
    rows = stash(packed_rows(kept, refs, scale))
    anchors = stash(packed_anchors(kept.where(F.col("vec_id") % every == 0).distinct(), refs, scale))
    shares = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, anchors.count())))

    best = meetings(anchors, rows, shares, positive_work(positives), _longs("anchor_block a anchor_id positive_id positive_score"))
    w = Window.partitionBy("anchor_block", "a").orderBy(F.desc("positive_score"), "positive_id")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= positives)
    windows = best.groupBy(F.col("anchor_block").alias("block")).agg(F.collect_list(F.struct("a", "rank", "positive_id", "positive_score")).alias("windows"))
    armed = stash(anchors.join(windows, "block"))

    found = meetings(armed, rows, shares, negative_work(negatives, low, high), _longs("anchor_block a anchor_id positive_rank positive_id positive_score negative_id negative_score"))
    w = Window.partitionBy("anchor_block", "a", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
