"""Centroid clustering with zone maps along a space-filling curve.

Vectors are put in Hilbert order and cut into blocks that carry the minimum and maximum of every component.  For a
block, the distances from a centroid to the nearest and farthest point of its box bound all distances in it: a
centroid whose nearest point is farther than another's farthest one is no candidate, nor is one that another beats
everywhere in the box.  The vectors of the block are compared with the candidates alone, exactly, in integers.

The blocks are written once and read in every round; a round brings back k rows of sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash

#: Vectors in a block; components and bits of each that make the curve's key of 63 bits.
BLOCK_ROWS, CURVE_DIMS, CURVE_BITS = 256, 9, 7
#: Scaled components must stay below this for squared distances in 64 bits; below EXACT, doubles hold them exactly.
LARGEST, EXACT = 1 << 27, 1 << 22


def hilbert_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points ``cells`` (n x dims, below 2^bits), as 64-bit integers.

    dims * bits may be 63 at most.  Walks the bits from the top: each cell's quadrant is reflected or exchanged with the
    first axis, and the Gray code of the result, interleaved, is the key.
    """
    x = cells.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        low, bit = np.uint64(q - 1), np.uint64(q)
        for i in range(dims):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.uint64), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def scaled(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, q): the vectors of ``dims`` finite components, each floor(scale * component)."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where((F.size("embedding") == dims) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = np.floor(scale * _matrix(b.column("x"), dims))
                if np.abs(q).max(initial=0) >= LARGEST:
                    raise ValueError(f"a scaled component of {LARGEST} or more: squared distances would not fit 64 bits")
                flat = pa.ListArray.from_arrays(np.arange(0, q.size + 1, dims, dtype=np.int32), pa.array(q.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), flat], ["vec_id", "q"])

    return kept.mapInArrow(run, "vec_id long, q array<int>")


def zone_blocks(points: DataFrame, dims: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, q) to blocks in Hilbert order: ids, q (32-bit rows), low, high, as bytes.

    The curve runs through the components of the largest variance, each cut into equal cells over the middle of its
    range (three deviations either way).  Equal keys are told apart by a hash of the id, so that many copies of a vector are
    spread over tasks.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b.column("q"), dims).astype(float)
            n = np.full(dims, len(q), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(dims, dtype=np.int32), n, q.sum(0), (q * q).sum(0))], ["i", "n", "s", "ss"])

    stats = points.mapInArrow(moments, "i int, n long, s double, ss double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    means = {r["i"]: (r["s"] / r["n"], max(0.0, r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2)) for r in stats.where("n > 0").collect()}
    spread = sorted(means, key=lambda i: (-means[i][1], i))[:CURVE_DIMS]
    middle = np.array([means[i][0] for i in spread])
    reach = np.array([3 * means[i][1] ** 0.5 + 1e-9 for i in spread])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = ((_matrix(b.column("q"), dims)[:, spread] - middle) / reach + 1) * (1 << (CURVE_BITS - 1))
            keys = hilbert_keys(np.clip(cells, 0, (1 << CURVE_BITS) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column("vec_id"), b.column("q")], ["key", "vec_id", "q"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= block_rows:
                yield packed(held.slice(0, block_rows))
                held = held.slice(block_rows)
        if held is not None and held.num_rows:
            yield packed(held)

    def packed(t: pa.Table) -> pa.RecordBatch:
        q = _matrix(t.column("q").combine_chunks(), dims).astype(np.int32)
        ids = t.column("vec_id").combine_chunks()
        known = np.packbits(~np.asarray(ids.is_null())).tobytes()
        values = ids.fill_null(0).to_numpy().astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (values.tobytes(), known, q.tobytes(), q.min(0).tobytes(), q.max(0).tobytes())], ["ids", "known", "q", "low", "high"])

    rows = points.mapInArrow(keyed, "key long, vec_id long, q array<int>").withColumn("salt", F.xxhash64("vec_id"))
    rows = rows.repartitionByRange("key", "salt").sortWithinPartitions("key", "salt").select("vec_id", "q")
    return rows.mapInArrow(cut, "ids binary, known binary, q binary, low binary, high binary")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers, ascending, of the centroids (k x dims, int64) that some point of the box may have as its nearest.

    Every comparison is of integers and ties are kept for the smaller number, so no vector loses its centroid.
    """
    below, above = low - centroids, centroids - high
    nearest = (np.maximum(np.maximum(below, above), 0) ** 2).sum(1)
    farthest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(1)
    left = np.flatnonzero(nearest <= farthest.min())
    if len(left) < 2:
        return left
    # |x-a|^2 - |x-b|^2 is linear in x: its largest value over the box says whether a beats b everywhere
    c = centroids[left]
    square = (c**2).sum(1)
    away = 2 * (c[None, :, :] - c[:, None, :])  # [a, b]: 2 (b - a)
    most = square[:, None] - square[None, :] + np.where(away > 0, away * high, away * low).sum(2)
    first = np.arange(len(left))
    beats = (most < 0) | ((most == 0) & (first[:, None] < first[None, :]))
    return left[~beats.any(0)]


def nearest(q: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid of ``among``; ties to the smaller number."""
    c = centroids[among]
    if max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)) < EXACT and q.shape[1] <= 64:
        x, y = q.astype(float), c.astype(float)  # all terms below 2^53: doubles are exact
        d = (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)
    else:
        d = np.stack([((q.astype(np.int64) - row) ** 2).sum(1) for row in c], 1)
    best = d.argmin(1)
    return among[best], d[np.arange(len(q)), best].astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
    """(block, its vectors, each one's centroid and distance, number of candidates)."""
    dims = centroids.shape[1]
    for b in batches:
        for row in b.to_pylist():
            low, high = (np.frombuffer(row[n], np.int32).astype(np.int64) for n in ("low", "high"))
            q = np.frombuffer(row["q"], np.int32).reshape(-1, dims)
            among = candidates(low, high, centroids)
            yield row, q, *nearest(q, centroids, among), len(among)


def centroid_step(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """One round's counts and component sums by cluster; k * dims rows come to the driver."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, q, own, _, _ in _blocks(batches, centroids):
            for c in np.unique(own):
                mine = own == c
                count[c] += mine.sum()
                sums[c] += q[mine].sum(0, dtype=np.int64)
        used = np.flatnonzero(count)
        columns = (np.repeat(used, dims).astype(np.int32), np.tile(np.arange(dims, dtype=np.int32), len(used)), np.repeat(count[used], dims), sums[used].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "i", "n", "s"])

    parts = blocks.mapInArrow(run, "cluster int, i int, n long, s long").groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    total: dict[int, tuple[int, list[int]]] = {}
    for r in parts.collect():
        total.setdefault(r["cluster"], (r["n"], [0] * dims))[1][r["i"]] = int(r["s"])
    return total


def first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest sha256 of ``seed:vec_id``, equal ones by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = points.select(digest.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: int = 3) -> DataFrame:
    """Lloyd's rounds in integers over (vec_id, embedding), then a last assignment.

    Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 (of the final centroid's
    components).  Vectors of another length, null ones and those with a null or non-finite component take no part;
    repeated rows take part each; a null vec_id counts as an empty one where first centroids are drawn; with fewer than k vectors there
    are fewer centroids; an empty table gives no rows.  Other columns are ignored.  Components of 2^27 or more
    after scaling are an error, since distances would not fit a long.  Rounds end early once no centroid moves, which changes
    nothing.
    """
    spark = vectors.sparkSession
    points = scaled(vectors, dims, scale)
    blocks = stash(zone_blocks(points, dims))
    centroids = first_centroids(points, k, seed)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], out)
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (n, sums) in centroid_step(blocks, centroids).items():
            moved[c] = [s // n for s in sums]
        if (moved == centroids).all():
            break
        centroids = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, own, distance, n in _blocks(batches, centroids):
            known = np.unpackbits(np.frombuffer(row["known"], np.uint8))[: len(own)].astype(bool)
            ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~known)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(distance), pa.array(np.full(len(own), n, np.int32))], ["vec_id", "cluster", "distance", "n_candidates"])

    found = stash(blocks.mapInArrow(run, "vec_id long, cluster int, distance long, n_candidates int"))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, s, sum(sums.values()), shas[c]) for c, s in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_candidates")
