"""Document fingerprints by I-Match over randomised lexicon subsets.

Terms are distinct words whose inverse document frequency lies in a band.  The subsets are fixed for the whole
corpus: of the lexicon, subset (density d, number k) holds the terms whose k-th hash begins with d zero bits, a share
of 2**-d.  A document's terms in a subset, distinct and sorted, are hashed to one value.  The fingerprint lists the
values of ``SUBSETS`` subsets at each density that leaves the document about one term or fewer; denser ones would
differ at any edit.  Two fingerprints are as alike as the share of subsets with equal values among those not empty in
both, over all densities that both list; it estimates the Jaccard similarity of the terms, whatever the sizes.

The lexicon has at most (mean distinct terms of a document) / LOW terms, whatever the number of documents, since
document frequencies add up to the distinct terms of all documents: that bounds its broadcast.  The fingerprint has a
second part, over the terms outside the band; it weighs ``OUTSIDE`` as much, so it decides only where the band is empty.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash
from .text_kernel import hashed_texts, mix64

LOW, HIGH, SUBSETS, DEPTH, OUTSIDE = 5e-4, 0.25, 32, 40, 0.02
#: Bytes of text in one run of neighbouring documents, the most runs, and the sampled ids that say where to cut.
RUN_BYTES, MOST_RUNS, CUT_ROWS = 32 << 20, 50_000, 200_000
_SALT = mix64(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FIRST = -(1 << 63)


def _distinct(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text's distinct words, sorted, and the texts they belong to."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((words, owner))
    words, owner = words[order], owner[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    return words[new], owner[new]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, words, first in hashed_texts(batch["text"]):
            terms, n = np.unique(_distinct(words, first)[0], return_counts=True)
            yield pa.record_batch({"term": pa.array(terms.view(np.int64)), "n": pa.array(n)})


def band_lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms with document frequency from ``low`` (two at least) to ``high`` of all documents."""
    total = docs.count()
    counts = docs.select("text").mapInArrow(_term_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = stash(counts.where((F.col("n") >= max(2, low * total)) & (F.col("n") <= max(2, high * total))).select("term"))
    return np.sort(band.toArrow()["term"].to_numpy().view(np.uint64))


def subset_values(terms: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first density that each of ``n`` texts lists, and for each density the (n, SUBSETS) values, 0 where empty.

    ``terms`` are distinct and sorted within a text, texts in order.  A value is a polynomial of the kept terms in
    their order, mixed and cut to a byte; the last density is the first that is empty for all.
    """
    size = np.bincount(owner, minlength=n)
    start = np.maximum(0, np.frexp(np.maximum(size, 1).astype(float))[1] - 1)
    levels: list[np.ndarray] = []
    power = np.cumprod(np.full(max(int(size.max(initial=1)), 1), _STEP, np.uint64))
    for k, salt in enumerate(_SALT):
        drawn = mix64(terms ^ salt)
        kept = np.arange(len(terms))
        for d in range(DEPTH):
            if d:
                kept = kept[drawn[kept] < np.uint64(1 << (64 - d))]
            used = kept[start[owner[kept]] <= d]
            if not len(kept):
                break
            if d >= len(levels):
                levels.append(np.zeros((n, SUBSETS), np.uint8))
            if not len(used):
                continue
            own = owner[used]
            at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            place = np.arange(len(used)) - np.repeat(at, np.diff(np.append(at, len(used))))
            total = np.add.reduceat(mix64(terms[used]) * power[place], at)
            levels[d][own[at], k] = mix64(total) % np.uint64(255) + np.uint64(1)
    return start, levels


class Fingerprint:
    """Of the terms in and outside the band: the first listed density and the values from there on."""

    __slots__ = ("parts", "text")

    def __init__(self, parts: list[tuple[int, np.ndarray]], raw: str):
        self.parts = parts
        if not any(len(v) for _, v in parts):
            self.text = "e" + sha256(raw.encode()).hexdigest()[:16] if raw else "e"
        else:
            self.text = ".".join(f"{s:x}:{v.tobytes().hex()}" if len(v) else "-" for s, v in parts)

    def __str__(self) -> str:
        return self.text

    def like(self, other: Fingerprint) -> float:
        """0 to 1; 1 for equal fingerprints."""
        if self.text == other.text:
            return 1.0
        equal, seen = 0.0, 0.0
        for weight, (s, x), (t, y) in zip((1.0, OUTSIDE), self.parts, other.parts):
            if not len(x) and not len(y):
                continue
            lo = max(s if len(x) else 0, t if len(y) else 0)
            depth = max(s + len(x), t + len(y))
            a, b = (np.zeros((max(depth - lo, 0), SUBSETS), np.uint8) for _ in range(2))
            a[: max(0, s + len(x) - lo)] = x[max(0, lo - s) :]
            b[: max(0, t + len(y) - lo)] = y[max(0, lo - t) :]
            some = (a > 0) | (b > 0)
            equal += weight * float(((a == b) & some).sum())
            seen += weight * float(some.sum())
        return equal / seen if seen else 0.0


def _parts(terms: np.ndarray, owner: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """A (first density, values) pair for each text; the values end with the last density that is not empty."""
    start, levels = subset_values(terms, owner, n)
    table = np.stack(levels) if levels else np.zeros((0, n, SUBSETS), np.uint8)
    held = table.any(2)
    deep = np.where(held.any(0), len(levels) - held[::-1].argmax(0), 0) if len(levels) else np.zeros(n, int)
    return [(int(s), table[s:e, i]) for i, (s, e) in enumerate(zip(start, deep))]


def _prints(texts: list[str], lexicon: np.ndarray) -> list[Fingerprint]:
    out = []
    with np.errstate(over="ignore"):
        for row, words, first in hashed_texts(pa.array(texts, pa.large_string())):
            n = len(first) - 1
            terms, owner = _distinct(words, first)
            at = np.searchsorted(lexicon, terms)
            inside = lexicon[np.minimum(at, len(lexicon) - 1)] == terms if len(lexicon) else np.zeros(len(terms), bool)
            both = [_parts(terms[x], owner[x], n) for x in (inside, ~inside)]
            out += [Fingerprint([a, b], texts[row + i]) for i, (a, b) in enumerate(zip(*both))]
    return out


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``docs`` in runs of ascending doc_id, each run ending in a copy (``head``) of the row after it.

    Runs hold about ``RUN_BYTES`` of text and are one task each; they are cut at quantiles of a hashed choice of at
    most about ``CUT_ROWS`` ids, so none is long, and the rows that follow them are as few as the runs.  After the
    last row comes the first.  Null ids come first; rows that share an id go by a hash of their text, and only equal
    rows are never divided.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("k")
    keyed = docs.select(key, F.xxhash64("text").alias("h"), *columns)
    share = min(1.0, CUT_ROWS / max(docs.count(), 1))
    ids = keyed.where(F.pmod(F.xxhash64("k", "h"), F.lit(1 << 30)) < int(share * (1 << 30)))
    picked = sorted((r.k, r.h, r.n or 0) for r in ids.select("k", "h", F.octet_length("text").alias("n")).collect())
    runs = min(MOST_RUNS, int(sum(n for _, _, n in picked) / share) // RUN_BYTES + 1)
    runs = max(runs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted({picked[len(picked) * i // runs][:2] for i in range(1, runs)}) if picked else []

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            run = [bisect_right(cuts, x) for x in zip(b["k"].to_pylist(), b["h"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), *b.columns], ["run", *b.schema.names])

    placed = keyed.mapInArrow(place, f"run int, {kinds}")
    least = keyed.select("k", "h").mapInArrow(place, "run int, k long, h long").groupBy("run").agg(F.min(F.struct("k", "h")).alias("x"))
    firsts = sorted((r.run, (r.x.k, r.x.h)) for r in least.collect())  # at most MOST_RUNS rows
    after = {x: firsts[i - 1][0] for i, (_, x) in enumerate(firsts)}  # its row ends the run before it
    rows = spark.createDataFrame([(*x, run) for x, run in after.items()] or [(_FIRST, 0, -1)], "k long, h long, run int")
    heads = keyed.join(F.broadcast(rows), ["k", "h"]).groupBy("run", "k", "h").agg(F.first(F.struct(*columns)).alias("r"))
    heads = heads.select("run", "k", "h", "r.*", F.lit(True).alias("head"))
    every = placed.withColumn("head", F.lit(False)).unionByName(heads)
    return every.repartitionById(len(cuts) + 1, F.col("run")).sortWithinPartitions("run", "head", "k", "h")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Of every row: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by the beginning of the next document's text (null: empty).
    A single row is its own next one.  Texts without words have the fingerprint of their characters alone.  Rows
    that share a doc_id follow one another in the order of a hash of their texts.  Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    lexicon = docs.sparkSession.sparkContext.broadcast(band_lexicon(docs))

    def compute(rows: list[tuple]) -> pa.RecordBatch:
        """All rows but the last, which is the next of the one before it or the head of another run."""
        texts = [r[3] for r in rows]
        edited = []
        for a, b in zip(texts, texts[1:]):
            k = len(a) // 4
            edited.append(a[: len(a) - k] + b[:k])
        own, new = _prints(texts, lexicon.value), _prints(edited, lexicon.value)
        keep = [i for i in range(len(rows) - 1) if not rows[i][1]]
        return pa.record_batch({
            "doc_id": pa.array([rows[i][2] for i in keep], pa.int64()),
            "n_chars": pa.array([len(texts[i]) for i in keep], pa.int64()),
            "edited_sha256": pa.array([sha256(edited[i].encode()).hexdigest() for i in keep], pa.string()),
            "fingerprint": pa.array([str(own[i]) for i in keep], pa.string()),
            "edited_fingerprint": pa.array([str(new[i]) for i in keep], pa.string()),
            "near_edited": pa.array([own[i].like(new[i]) for i in keep], pa.float64()),
            "near_next": pa.array([own[i].like(own[i + 1]) for i in keep], pa.float64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for r in zip(b["run"].to_pylist(), b["head"].to_pylist(), b["doc_id"].to_pylist(), b["text"]):
                text = r[3].as_py() or ""
                rows.append((*r[:3], text))
                size += len(text)
                if size >= 1 << 20 and len(rows) > 1:
                    yield compute(rows)
                    rows = rows[-1:]
                    size = len(rows[0][3])
        if len(rows) > 1:
            yield compute(rows)

    return with_next(docs, ["doc_id", "text"]).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
