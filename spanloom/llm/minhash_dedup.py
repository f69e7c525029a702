"""MinHash near-duplicates with tensored banding.

``m * m`` tables are formed from two collections of only ``m`` band hashes each: table (i, j) is keyed by the
pair (left band i, right band j).  With r rows a band, 2*m*r min-hashes do the work of 2*r*m*m.  A pair of
similarity s shares no table with probability at most 2*(1 - s**r)**m, which is 2e-5 at s = 0.75 with the
defaults r = 2 and m = 14, and falls quickly above.  Candidates are confirmed on the full shingle sets.

Texts with equal sets are one class before anything is joined, so copies in any number cost one row.  Nulls
and texts without words have an empty set and no links.  Rows that share a doc_id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import link_buckets
from .shared import checked_broadcast, drop, stash
from .text_kernel import digest, hashed_texts, mix64, shingle_set

BANDS, ROWS, WIDTH, PERCENT = 14, 2, 5, 75


def _signer(width: int, bands: int, rows: int):
    mult = np.random.default_rng(11).integers(0, 2**63, 2 * bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = mix64(np.arange(1, 2 * bands + 1, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for row, words, first in hashed_texts(batch["text"]):
                    n = len(first) - 1
                    counts, keys, names = np.zeros(n, np.int64), np.zeros((n, 2 * bands), np.uint64), [None] * n
                    for i in range(n):
                        values = shingle_set(words[first[i] : first[i + 1]], width)
                        if not len(values):
                            continue
                        counts[i], names[i] = len(values), digest(values)
                        low = np.array([(values * a).min() for a in mult], np.uint64).reshape(2 * bands, rows)
                        key = salt.copy()
                        for r in range(rows):
                            key = mix64(key + low[:, r])
                        keys[i] = key
                    flat = keys.view(np.int64)
                    offs = np.arange(0, n * bands + 1, bands, dtype=np.int32)
                    yield pa.record_batch({
                        "doc_id": batch["doc_id"].slice(row, n),
                        "n_shingles": pa.array(counts),
                        "cls": pa.array(names, pa.binary()),
                        "lefts": pa.ListArray.from_arrays(offs, pa.array(flat[:, :bands].ravel())),
                        "rights": pa.ListArray.from_arrays(offs, pa.array(flat[:, bands:].ravel())),
                    })

    return sign


def _set_maker(width: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words, first in hashed_texts(batch["text"]):
                sets = [shingle_set(words[first[i] : first[i + 1]], width) for i in range(len(first) - 1)]
                offs = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(s) for s in sets], out=offs[1:])
                yield pa.record_batch({
                    "id": batch["doc_id"].slice(row, len(sets)),
                    "n": pa.array(np.diff(offs).astype(np.int64)),
                    "s": pa.ListArray.from_arrays(offs, pa.array(np.concatenate(sets).view(np.int64))),
                })

    return make


def _block_linker(percent: int):
    """Exact links of outliers to members of other components in their group, by counting through an inverted index."""

    def link(task: pa.Table, group: np.ndarray) -> pa.Table:
        ids, comp = task["id"].to_numpy(), task["component"].to_numpy()
        is_q, is_x = task["q"].to_numpy(zero_copy_only=False), task["x"].to_numpy(zero_copy_only=False)
        lists = task["s"].combine_chunks()
        flat, offs = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        size = np.diff(offs)
        owner = np.repeat(np.arange(len(ids)), size)
        with np.errstate(over="ignore"):  # shingles of different groups are different terms
            terms_of = mix64(flat.view(np.uint64) + mix64(group[owner].astype(np.uint64) + np.uint64(1)))
        uniq, inverse = np.unique(terms_of, return_inverse=True)
        held = is_x[owner]
        order = np.argsort(inverse[held], kind="stable")
        posted, start = owner[held][order], np.searchsorted(inverse[held][order], np.arange(len(uniq) + 1))
        a, b = [], []
        for q in np.flatnonzero(is_q):
            terms = inverse[offs[q] : offs[q + 1]]
            lo, n = start[terms], start[terms + 1] - start[terms]
            lo, n = lo[n > 0], n[n > 0]
            if not len(n):
                continue
            at = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            met, both = np.unique(posted[at], return_counts=True)
            hit = met[(100 * both >= percent * (size[q] + size[met] - both)) & (comp[met] != comp[q])]
            if len(hit):
                _, one = np.unique(comp[hit], return_index=True)
                a += [ids[q]] * len(one)
                b += ids[hit[one]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links of ``100 * shared >= percent * union`` distinct
    ``width``-word shingles; kept says whether the row's doc_id is that one.  Texts of any length are read whole, a
    chunk at a time; a row without an id joins no group but takes its class's component_id; other columns, whatever
    their names, are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = stash(docs.mapInArrow(
        _signer(width, bands, rows), "doc_id long, n_shingles long, cls binary, lefts array<long>, rights array<long>"))
    classes = stash(signed.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("id")))
    reps = signed.join(classes.select("id").distinct(), signed.doc_id == F.col("id"), "left_semi").where("cls is not null")
    reps = stash(reps.select(F.col("doc_id").alias("id"), "lefts", "rights").distinct())

    # a table can only hold two documents whose left and right bands are both shared with someone
    def shared(column: str) -> DataFrame:
        rows_ = reps.select("id", F.posexplode(column).alias("p", "v"))
        keys = rows_.groupBy("p", "v").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("p", "v")
        return rows_.join(keys, ["p", "v"])

    lefts = stash(shared("lefts"))
    rights = shared("rights").join(lefts.select("id").distinct(), "id", "left_semi")
    tables = lefts.join(rights.select("id", F.col("p").alias("p2"), F.col("v").alias("v2")), "id").select(
        F.xxhash64("p", "v", "p2", "v2").alias("key"), "id")
    full = tables.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    tables = stash(tables.join(full, "key"))
    live = stash(tables.select("id").distinct())
    coarse = lefts.join(live, "id", "left_semi").select(F.xxhash64("p", "v").alias("key"), "id")
    wanted = checked_broadcast(live)
    items = stash(docs.join(wanted, docs.doc_id == wanted.id, "left_semi").distinct().mapInArrow(_set_maker(width), "id long, n long, s array<long>"))

    def verify(pairs: DataFrame) -> DataFrame:
        x = items.select(F.col("id").alias("a"), F.col("n").alias("na"))
        y = items.select(F.col("id").alias("b"), F.col("n").alias("nb"))
        likely = pairs.join(x, "a").join(y, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b")
        sa, sb = items.select(F.col("id").alias("a"), F.col("s").alias("sa")), items.select(F.col("id").alias("b"), F.col("s").alias("sb"))
        both = likely.join(sb, "b").join(sa, "a").withColumn("k", F.size(F.array_intersect("sa", "sb")))
        return both.where(F.expr(f"100 * k >= {percent} * (size(sa) + size(sb) - k)")).select("a", "b")

    hubs = tables.groupBy("key").agg(F.min("id").alias("a"))
    stars = tables.join(hubs, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    parts = link_buckets(stars, coarse, lambda _: items.drop("n"), verify, _block_linker(percent), items.select("id", F.col("n").alias("units")))
    for x in (reps, lefts, tables, live, items):
        drop(x)
    grouped = classes.join(parts, "id", "left").select("cls", F.coalesce("component", "id").alias("component_id"))
    grouped = grouped.groupBy("cls").agg(F.min("component_id").alias("component_id"))
    return (
        signed.select("doc_id", "n_shingles", "cls").join(grouped, "cls", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
