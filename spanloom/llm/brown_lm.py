"""Language-model scoring with Brown classes: P(word | previous) = P(class | previous class) * P(word | class).

Classes come in two steps.  Exchange clustering on bigram counts assigns the ``TOP`` most frequent words, and
``ENDINGS`` groups of all words by their last two bytes, to ``CLASSES`` classes.  Then each further word of the ``NEAR``
most frequent ones is inserted into the class in which the class bigram likelihood rises most, by its own counts of
classes before and after it: one distributed aggregation and one row a word, so no size of vocabulary strains the
driver.  Words beyond ``NEAR`` have the class of their ending, so every word, seen or not, has a class without a
look-up; NEAR bounds only the broadcast of classes, and is a parameter.

Word counts, class bigrams and class sums come from all training documents.  What the score takes from the whole
vocabulary is additive over a text's words (the logarithm of each word's count), so counts meet words in one join on
the word, and neither side is ever held by one task: the ``NEAR`` most frequent words' counts are broadcast, all others
are joined.

With one unseen word for each class, the probabilities of a class's words add up to 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import least_count, stash
from .text_kernel import _LOWER, text_chunks, word_hashes, word_spans

TOP, ENDINGS, CLASSES, NEAR, SWEEPS, PULL = 1000, 200, 64, 1 << 17, 12, 4.0
CHUNK = 4 << 20


def _endings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    last = _LOWER[raw[ends - 1]].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    longer = ends - starts > 1
    other = np.where(longer, _LOWER[raw[np.maximum(ends - 2, 0)]], 0) if len(ends) else last
    return (last * 257 + other) * 2654435761 % 4294967291 % ENDINGS


def _words(batch: pa.RecordBatch):
    """(first row, hashes, endings, index of each text's first word) by chunks."""
    with np.errstate(over="ignore"):
        for row, raw, offsets in text_chunks(batch["text"], CHUNK):
            starts, ends, first = word_spans(raw, offsets)
            yield row, word_hashes(raw, starts, ends), _endings(raw, starts, ends), first


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, words, endings, _ in _words(batch):
            h, at, n = np.unique(words, return_index=True, return_counts=True)
            yield pa.record_batch({"h": pa.array(h.view(np.int64)), "ending": pa.array(endings[at]), "n": pa.array(n)})


class Items:
    """Item numbers: frequent words, endings, then END; START stands only before a text's first word."""

    def __init__(self, top: np.ndarray):
        self.order = np.argsort(top)
        self.top = top[self.order]
        self.end, self.start = len(top) + ENDINGS, len(top) + ENDINGS + 1
        self.size = self.start + 1

    def of(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        rest = endings + len(self.top)
        if not len(self.top):
            return rest
        at = np.minimum(np.searchsorted(self.top, words), len(self.top) - 1)
        return np.where(self.top[at] == words, self.order[at], rest)

    def pairs(self, words, endings, first) -> tuple[np.ndarray, np.ndarray]:
        """Previous and own item of every token, each text with its START and END."""
        n = len(first) - 1
        cuts = first + np.arange(n + 1)
        own = np.full(len(words) + n, self.end)
        own[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(first))] = self.of(words, endings)
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[cuts[:-1]] = self.start
        return before, own


def exchange(pairs: np.ndarray, classes: int, free: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each item.  Items from ``free`` on keep classes of their own after the first ``classes`` ones.

    Each free item in turn goes to the class that most raises the class bigram likelihood, until a sweep moves
    none.  Deterministic: ties go to the lower class, items go by falling count.
    """
    m = len(pairs)
    total = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-total[:free], kind="stable")
    of = np.empty(m, int)
    of[order] = np.arange(free) % classes
    of[free:] = classes + np.arange(m - free)
    k = classes + m - free
    by = np.zeros((m, k))
    by[np.arange(m), of] = 1
    table = by.T @ pairs @ by
    right, left = pairs @ by, (by.T @ pairs).T  # counts of an item before, and after, each class
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not total[w]:
                continue
            old, r, l_, own = of[w], right[w].copy(), left[w].copy(), pairs[w, w]
            r[old] -= own
            l_[old] -= own
            table[old] -= r
            table[:, old] -= l_
            table[old, old] -= own
            base = table[:classes]
            gain = (f(base + r) - f(base)).sum(1) + (f(table[:, :classes] + l_[:, None]) - f(table[:, :classes])).sum(0)
            d = np.arange(classes)
            diag = table[d, d]
            gain += f(diag + r[d] + l_[d] + own) - f(diag + r[d]) - f(diag + l_[d]) + f(diag)
            out, into = table.sum(1)[:classes], table.sum(0)[:classes]
            ro, li = r.sum() + own, l_.sum() + own
            gain -= f(out + ro) - f(out) + f(into + li) - f(into)
            new = int(np.argmax(np.round(gain, 6)))
            if gain[new] <= gain[old] + 1e-6:
                new = old
            table[new] += r
            table[:, new] += l_
            table[new, new] += own
            if new != old:
                moved += 1
                of[w] = new
                right[:, old] -= pairs[:, w]
                right[:, new] += pairs[:, w]
                left[:, old] -= pairs[w]
                left[:, new] += pairs[w]
        if not moved:
            break
    return of


def insertion_gains(table: np.ndarray, before: np.ndarray, after: np.ndarray, alpha: float = 0.01) -> np.ndarray:
    """For words with (n, k) counts of the classes before and after them, how the likelihood rises with their share in each class.

    That is the derivative of the class bigram likelihood (alpha smooths empty cells), up to what all classes have in
    common.  The whole difference would favour empty classes, which every word would then choose for itself alone.
    """
    k = len(table)
    out, into = table.sum(1, keepdims=True), table.sum(0, keepdims=True)
    return after @ np.log((table + alpha) / (out + alpha * k)).T + before @ np.log((table + alpha) / (into + alpha * k))


def insert_words(training: DataFrame, classes: Classes, table: np.ndarray, free: int) -> np.ndarray:
    """Classes of the near words, those outside ``classes.fixed`` by their best insertion among the first ``free`` classes."""
    k, spark = len(table), training.sparkSession
    sent = spark.sparkContext.broadcast((classes, table))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value[0]
        for batch in batches:
            for _, words, endings, first in _words(batch):
                at, cls, cuts = own.tokens(words, endings, first)
                keys = []
                for side, shift in ((0, -1), (1, 1)):
                    here = np.flatnonzero(at >= 0)
                    near = here + shift
                    other = np.where(side == 0, own.start, own.end) * np.ones(len(here), np.int64)
                    inside = (near >= 0) & (near < len(cls))
                    if side == 0:
                        inside &= ~np.isin(here, cuts[:-1])
                    other[inside] = cls[near[inside]]
                    keys.append((at[here] * 2 + side) * k + other)
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.record_batch({"key": pa.array(key), "n": pa.array(n)})

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fixed = sent.value
        for batch in batches:
            for lo in range(0, len(batch["w"]), 500):
                part = batch.slice(lo, 500)
                counts = np.zeros((len(part["w"]), 2 * k))
                lists = part["c"]
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                counts[row, flat.field("s").to_numpy()] = flat.field("n").to_numpy()
                gain = insertion_gains(fixed, counts[:, :k], counts[:, k:])[:, :free]
                yield pa.record_batch({"w": part["w"], "cls": pa.array(np.argmax(np.round(gain, 6), 1).astype(np.int32))})

    counts = training.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counts.groupBy(F.expr(f"key div {2 * k}").alias("w")).agg(F.collect_list(F.struct((F.col("key") % (2 * k)).cast("int").alias("s"), "n")).alias("c"))  # at most 2k entries a word
    got = rows.mapInArrow(choose, "w long, cls int").toArrow()  # at most NEAR rows
    of = classes.of.copy()
    of[got["w"].to_numpy()] = got["cls"].to_numpy()
    return of


class Classes:
    """Classes of the near words (sorted hashes), of endings, of a text's START and END."""

    def __init__(self, known: np.ndarray, of: np.ndarray, fixed: np.ndarray, endings: np.ndarray, end: int, start: int):
        self.known, self.of, self.fixed, self.endings, self.end, self.start = known, of, fixed, endings, end, start

    def tokens(self, words: np.ndarray, endings: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every token, each text's END included: number of the near word to be inserted or -1, and class; and the texts' cuts."""
        n = len(first) - 1
        cuts = first + np.arange(n + 1)
        spot = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(first))
        at, cls = np.full(len(words) + n, -1), np.full(len(words) + n, self.end)
        cls[spot] = self.endings[endings]
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
            hit = self.known[place] == words
            cls[spot[hit]] = self.of[place[hit]]
            at[spot[hit]] = np.where(self.fixed[place[hit]], -1, place[hit])
        return at, cls, cuts

    def pairs(self, words, endings, first) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Previous and own class of every token, and the texts' cuts."""
        _, own, cuts = self.tokens(words, endings, first)
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[cuts[:-1]] = self.start
        return before, own, cuts


def held_out(column="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(5)) == 1, F.lit(False))


def class_scores(docs: DataFrame) -> DataFrame:
    """Of every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity.

    A null text is empty: its only token is the end.  With no training rows all counts are 0.  Texts of any length are
    scored whole; words of one count are ranked by their hashes; repeated rows count as often as they occur and are
    scored each alike; a null doc_id is a training row; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    training = docs.where(~held_out())
    vocabulary = stash(training.select("text").mapInArrow(_count_words, "h long, ending long, n long").groupBy("h", "ending").agg(F.sum("n").alias("n")))
    texts = training.count()
    by_ending = {r.ending: (r.v, r.n) for r in vocabulary.groupBy("ending").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()}
    frequent = vocabulary.where(F.col("n") >= least_count(vocabulary, NEAR))
    near = frequent.toPandas().sort_values(["n", "h"], ascending=[False, True], ignore_index=True)  # at most NEAR rows
    top = near.head(TOP)
    items = Items(top["h"].to_numpy().view(np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, table = sent.value.size, np.zeros(sent.value.size**2, np.int64)
        for batch in batches:
            for _, words, endings, first in _words(batch):
                before, own = sent.value.pairs(words, endings, first)
                table += np.bincount(before * size + own, minlength=size * size)
        at = np.flatnonzero(table)
        for lo in range(0, len(at), 10_000):
            yield pa.record_batch({"pair": pa.array(at[lo : lo + 10_000]), "n": pa.array(table[at[lo : lo + 10_000]])})

    got = training.select("text").mapInArrow(count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most size**2 rows
    pairs = np.zeros(items.size**2)
    pairs[got["pair"].to_numpy(int)] = got["n"].to_numpy(float)
    pairs = pairs.reshape(items.size, items.size)
    of = exchange(pairs, CLASSES, items.end)

    k = int(of.max()) + 1
    by = np.zeros((items.size, k))
    by[np.arange(items.size), of] = 1
    hashes = near["h"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    counts = near["n"].to_numpy(np.int64)[order]
    ending_class = of[len(top) : len(top) + ENDINGS]
    start_of = ending_class[near["ending"].to_numpy(np.int64)[order]]
    place = np.empty(len(near), np.int64)
    place[order] = np.arange(len(near))  # near row to place among the sorted
    start_of[place[: len(top)]] = of[: len(top)]
    fixed = np.zeros(len(near), bool)
    fixed[place[: len(top)]] = True
    classes = Classes(hashes[order], start_of, fixed, ending_class, int(of[items.end]), int(of[items.start]))
    classes.of = insert_words(training, classes, by.T @ pairs @ by, CLASSES) if len(near) > len(top) else start_of

    # class sums: of words seen and of distinct ones; then the class bigrams of all training texts
    mass = np.bincount(classes.of, weights=counts, minlength=k).astype(float)
    kinds = np.bincount(classes.of, minlength=k).astype(float)
    far = near.groupby("ending")["n"].agg(["count", "sum"])
    for e, (v, n) in by_ending.items():
        held, own = (far.loc[e, "count"], far.loc[e, "sum"]) if e in far.index else (0, 0)
        mass[ending_class[e]] += n - own
        kinds[ending_class[e]] += v - held
    mass[classes.end], kinds[classes.end] = texts, 1
    dealt = docs.sparkSession.sparkContext.broadcast(classes)

    def count_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for _, words, endings, first in _words(batch):
                before, own, _ = dealt.value.pairs(words, endings, first)
                total += np.bincount(before * k + own, minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.record_batch({"pair": pa.array(at), "n": pa.array(total[at])})

    got = training.select("text").mapInArrow(count_classes, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most k**2 rows
    table = np.zeros(k * k)
    table[got["pair"].to_numpy(int)] = got["n"].to_numpy(float)
    table = table.reshape(k, k)
    share = mass + 0.5
    share[classes.start] = 0
    share /= share.sum()
    step = np.log10((table + PULL * share) / (table.sum(1, keepdims=True) + PULL) + 1e-300)
    emit = -np.log10(mass + 0.5 * (kinds + 1))
    tokens = int(sum(n for _, n in by_ending.values())) + texts
    distinct = sum(v for v, _ in by_ending.values()) + (texts > 0)
    shipped = docs.sparkSession.sparkContext.broadcast((classes, step, emit, classes.known, counts))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, step, emit, known, counts = shipped.value
        for batch in batches:
            for row, words, endings, first in _words(batch):
                n = len(first) - 1
                before, own, cut = classes.pairs(words, endings, first)
                each = step[before, own] + emit[own]
                total = np.add.reduceat(each, cut[:-1]) if n else each
                hit = np.zeros(len(words), bool)
                c = np.zeros(len(words), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                    hit = known[at] == words
                    c = np.where(hit, counts[at], 0)
                sums = np.concatenate([[0.0], np.cumsum(np.where(hit, np.log10(c + 0.5), 0.0))])
                seen = np.concatenate([[0], np.cumsum(hit)])
                rest, each_n, offs = [], [], [0]
                for i in range(n):
                    own_rest = words[first[i] : first[i + 1]][~hit[first[i] : first[i + 1]]]
                    h, m = np.unique(own_rest, return_counts=True)
                    rest.append(h)
                    each_n.append(m)
                    offs.append(offs[-1] + len(h))
                offs = np.array(offs, np.int32)
                part = batch.slice(row, n)
                yield pa.record_batch({
                    "rid": part["rid"], "doc_id": part["doc_id"], "held": part["held"], "n_tokens": pa.array(np.diff(cut)),
                    "near_known": pa.array(np.diff(seen[first])), "near_log": pa.array(np.diff(sums[first])), "model": pa.array(total),
                    "h": pa.ListArray.from_arrays(offs, pa.array(np.concatenate(rest).view(np.int64))),
                    "m": pa.ListArray.from_arrays(offs, pa.array(np.concatenate(each_n).astype(np.int64))),
                })

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held_out().alias("held"), "text")
    rows = stash(rows.mapInArrow(local, "rid long, doc_id long, held boolean, n_tokens long, near_known long, near_log double, model double, h array<long>, m array<long>"))
    rare = rows.select("rid", F.explode(F.arrays_zip("h", "m")).alias("x")).select("rid", "x.h", "x.m")
    far = rare.join(vocabulary.select("h", "n"), "h", "left").groupBy("rid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("m"))).alias("far_known"),
        F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("far_log"),
    )
    end_log = float(np.log10(texts + 0.5))
    base = float(np.log10(tokens + 0.5 * (distinct + 1)))
    logs = F.col("near_log") + F.coalesce("far_log", F.lit(0.0)) + end_log
    return rows.drop("h", "m").join(far, "rid", "left").select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens",
        (F.col("near_known") + F.coalesce("far_known", F.lit(0)) + int(texts > 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * base).alias("base_score"),
        (logs + F.col("model")).alias("score"),
        F.pow(F.lit(10.0), -(logs + F.col("model")) / F.col("n_tokens")).alias("perplexity"),
    )
