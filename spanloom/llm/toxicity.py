"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and context windows.

1. The lexicon is learned from labelled training rows: terms whose documents are far more often toxic.
2. Its trie is intersected with Levenshtein automata (one edit, two for terms of eight letters or more).  The
   product is made deterministic lazily, so a word is matched in one pass over its characters and most words
   leave it after two or three.  A word with digits or signs for letters is also run in its plain spelling.
3. Each match looks at a window of words around it: quotation marks about the term, or a reporting word,
   make it a mention rather than abuse.  Exact and disguised matches, plain misspellings and mentions are
   separate features of a logistic model fitted on the same training rows.

Learning reads at most ``MAX_ROWS`` labelled rows (those whose hash of doc_id is small); everything else
covers whole tables.  Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import checked_broadcast
from .text_kernel import mix64, text_chunks, word_hashes, word_spans

#: Words whose kinds a worker keeps (some 100 bytes each); beyond, it begins anew.
KNOWN_WORDS = 500_000
MAX_ROWS, MIN_SHARE, MIN_LIFT, WINDOW, LEAST = 20_000, 0.01, 20.0, 5, 4
#: Signs commonly put for letters, quotation marks, words that report another's speech.
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
QUOTES = "\"'“”‘’«»„‹›`"
REPORTING = ("said", "says", "called", "calls", "wrote", "quote", "quoted", "word", "words", "term", "phrase", "uses", "used")
FEATURES = ("strong", "weak", "mention", "any_strong", "rate")
#: Prior means of the weights (intercept first), towards which the fit is drawn where the labels say little.
PRIOR = np.array([-4.0, 1.5, 0.2, 0.5, 3.0, 0.5])


class LexiconAutomaton:
    """The deterministic product of a lexicon's trie with Levenshtein automata."""

    def __init__(self, terms: list[str]):
        self.terms = sorted(set(terms))
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, int]] = [(-1, 0)]
        below: list[int] = [0]  # edits that the longest term under a node allows
        for k, term in enumerate(self.terms):
            edits, node = 2 if len(term) >= 8 else 1 if len(term) >= 4 else 0, 0
            below[0] = max(below[0], edits)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append((-1, 0))
                    below.append(0)
                node = self.next[node][c]
                below[node] = max(below[node], edits)
            self.ends[node] = (k, edits)
        self.below = below
        self.letters = {c for t in self.terms for c in t}
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.arcs: list[dict[str, int]] = []
        self.accept: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The state for trie nodes with their fewest edits, after adding what skipped letters reach; -1: none."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            for child in self.next[node].values():
                e = nodes[node] + 1
                if e <= self.below[child] and e < nodes.get(child, 9):
                    nodes[child] = e
                    todo.append(child)
        key = frozenset((n, e) for n, e in nodes.items() if e <= self.below[n])
        if not key:
            return -1
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.arcs.append({})
            best = min(((e, self.ends[n][0]) for n, e in key if self.ends[n][0] >= 0 and e <= self.ends[n][1]), default=None)
            self.accept.append(best)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        after: dict[int, int] = {}
        for n, e in self.sets[state]:
            for letter, child in self.next[n].items():
                cost = e + (letter != c)
                if cost <= self.below[child]:
                    after[child] = min(after.get(child, 9), cost)
            if e + 1 <= self.below[n]:
                after[n] = min(after.get(n, 9), e + 1)
        self.arcs[state][c] = to = self._state(after)
        return to

    def inside(self, run: str, at: int) -> bool:
        """Whether a term begins at a place in a run."""
        node = 0
        for k in range(at, len(run)):
            node = self.next[node].get(run[k], -1)
            if node < 0:
                return False
            if self.ends[node][0] >= 0:
                return True
        return False

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term index) of the nearest term within its bound, or None."""
        state, letters = self.start, self.letters
        if state < 0:
            return None
        for c in word:
            c = c if c in letters else "\0"
            to = self.arcs[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return None
        return self.accept[state]


_CORE = re.compile(r"\w(?:.*\w)?", re.S)
_MARK = re.compile(r"[\W\d_]")
_TWICE = re.compile(r"(.)\1", re.S)
_RUN = re.compile(r"(.)\1*", re.S)
_CUT = re.compile(r"[^\w*@$!|#%]+|_+")
#: Letters of scripts written without spaces: Thai to Myanmar, Khmer, kana, Han.
_ALONE = "\u0e00-\u109f\u1780-\u17ff\u3040-\u312f\u31a0-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_SPACELESS = re.compile(f"[{_ALONE}]+")
GRAMS = (2, 3, 4)


def _core(word: str) -> str:
    found = _CORE.search(word)
    return found[0] if found else ""


def _runs(word: str) -> tuple[str, list[int]]:
    """The word with every run of one letter squeezed to one, and the runs' lengths."""
    runs = [(m[1], m.end() - m.start()) for m in _RUN.finditer(word)]
    return "".join(c for c, _ in runs), [n for _, n in runs]


class Scorer:
    """Features of texts; one for each Python worker, since the automaton grows as words ask for it."""

    def __init__(self, terms: list[str]):
        self.automaton = LexiconAutomaton(terms)
        self.known: dict[int, int] = {}  # kinds of words by their hashes, until there are too many
        self.stretched: dict[str, list[list[int]]] = {}
        for t in self.automaton.terms:
            letters, runs = _runs(t)
            self.stretched.setdefault(letters, []).append(runs)

    def _whole(self, word: str) -> int:
        core = _core(word)
        if not core:
            return 0
        found = self.automaton.match(core)
        if found and found[0] == 0:
            return 2
        if _TWICE.search(core):
            letters, runs = _runs(core)
            if any(all(a >= b for a, b in zip(runs, term)) for term in self.stretched.get(letters, ())):
                return 2  # letters of a term, some of them repeated
        if _MARK.search(word):
            plain = _core(word.strip(".,;:?()[]{}" + QUOTES).translate(PLAIN))
            other = self.automaton.match(plain)
            if other and (other[0] == 0 or _MARK.search(core) and other[0] == 1):
                return 2
        return 1 if found else 0

    def kind(self, word: str) -> int:
        """0: no match, 1: a plain misspelling, 2: the term itself or a disguise of it.

        Of a run that signs divide each part counts too, of one in a script without spaces each place in it.
        """
        word = word.lower()
        best = self._whole(word)
        if best < 2 and _CUT.search(word):
            best = max(best, max((self._whole(part) for part in set(_CUT.split(word)) if part), default=0))
        if best < 2 and not word.isascii():
            for run in _SPACELESS.finditer(word):
                if any(self.automaton.inside(run[0], k) for k in range(len(run[0]))):
                    return 2
        return best

    def features(self, column: pa.Array) -> np.ndarray:
        """One row for each text: FEATURES."""
        out = np.zeros((len(column), len(FEATURES)))
        with np.errstate(over="ignore"):
            for row, raw, offsets in text_chunks(column):
                starts, ends, first = word_spans(raw, offsets)
                codes, at, inverse = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
                data = raw.tobytes()
                if len(self.known) > KNOWN_WORDS:
                    self.known.clear()
                kinds = np.fromiter((self.known.get(h, -1) for h in codes.tolist()), np.int8, len(codes))
                new = np.flatnonzero(kinds < 0)
                kinds[new] = [self.kind(data[a:b].decode("utf-8", "replace")) for a, b in zip(starts[at[new]], ends[at[new]])]
                self.known.update(zip(codes[new].tolist(), kinds[new].tolist()))
                hits = np.flatnonzero(kinds[inverse] > 0)
                owner = np.searchsorted(first, hits, "right") - 1
                strength = kinds[inverse][kinds[inverse] > 0]
                for h, doc, k in zip(hits, owner, strength):
                    lo, hi = max(first[doc], h - WINDOW), min(first[doc + 1], h + WINDOW + 1)
                    before, own, after = (data[starts[a] : ends[b - 1]].decode("utf-8", "replace") if b > a else "" for a, b in ((lo, h), (h, h + 1), (h + 1, hi)))
                    self._count(out[row + doc], k, before, own, after)
                words = np.diff(first)
                part = out[row : row + len(words)]
                part[:, 3] = part[:, 0] > 0
                part[:, 4] = np.log1p(100 * part[:, 0] / np.maximum(words, 1))
        out[:, :3] = np.log1p(out[:, :3])
        return out

    def _count(self, into: np.ndarray, kind: int, before: str, own: str, after: str) -> None:
        opened = own[:1] in QUOTES or any(w[:1] in QUOTES and w[-1:] not in QUOTES for w in before.split())
        closed = own.rstrip(".,;:!?")[-1:] in QUOTES or any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in after.split())
        reported = any(w.strip(".,;:!?").lower() in REPORTING for w in before.split()[-2:])
        into[2 if opened and closed or reported else 0 if kind == 2 else 1] += 1


_LETTER = re.compile(r"[^\W\d_](?:.*[^\W\d_])?", re.S)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, term, kin0, kin1, kin2) of each text's possible terms."""
    for batch in batches:
        for toxic, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist()):
            raw = text.lower().split()
            codes = np.array([hash_word(w) for w in raw] or [0], np.uint64)
            threes = mix64(mix64(mix64(codes[:-2]) + codes[1:-1]) + codes[2:]) if len(codes) > 2 else codes
            kin = [int(mix64(threes ^ np.uint64(k)).min().view(np.int64)) for k in range(3)]
            found = set()
            for w in raw:
                if w[0] in QUOTES or w.rstrip(".,;:!?")[-1:] in QUOTES:
                    continue
                m = _LETTER.search(w)
                if m:
                    found.add(m[0])
            for run in _SPACELESS.findall(text):
                found.update(run[k : k + n] for n in GRAMS for k in range(len(run) - n + 1))
            terms = sorted(found)
            yield pa.record_batch({
                "toxic": pa.array([toxic] * len(terms), pa.int64()), "term": pa.array(terms, pa.string()),
                **{f"kin{k}": pa.array([x] * len(terms), pa.int64()) for k, x in enumerate(kin)},
            })


def hash_word(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def learn_lexicon(rows: DataFrame) -> list[str]:
    """Terms of ``rows(text, toxic)``: those in far more toxic texts than in others.

    A term counts as often as its texts have distinct least hashes of three words, by the least of three hashes: near
    copies of one document mostly share those, so they and equal texts count about once.

    Terms may have any length; those of fewer than four letters match exactly or in disguise only, without edits.
    Words with a quotation mark at an end are mentions and count on neither side.  Runs in scripts without spaces
    count by their letter sequences of ``GRAMS`` letters.
    """
    rows = rows.groupBy(F.xxhash64("text").alias("t")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    sides = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    toxic, clean = int(sides[0]), int(sides[1] - sides[0])
    if not toxic or not clean:
        return []
    kin = ("kin0", "kin1", "kin2")
    words = rows.select("toxic", "text").mapInArrow(_term_rows, "toxic long, term string, kin0 long, kin1 long, kin2 long")
    side = lambda k, n: F.coalesce(F.sum(F.when(F.col("toxic") == k, n)), F.lit(0))
    lift = (F.col("t") + 0.01) / toxic / ((F.col("c") + 0.5) / clean)
    least = max(LEAST, int(np.ceil(MIN_SHARE * toxic)))
    # the distinct counts are of those terms only that toxic texts hold often enough, and twice as often as others, at all
    often = words.groupBy("term").agg(side(1, F.lit(1)).alias("t"), side(0, F.lit(1)).alias("c"))
    often = often.where((F.col("t") >= least) & (F.col("t") / toxic >= 2 * F.col("c") / clean)).select("term")
    terms = words.join(checked_broadcast(often), "term", "left_semi").groupBy("term", "toxic").agg(F.least(*(F.count_distinct(c) for c in kin)).alias("n"))
    terms = terms.groupBy("term").agg(side(1, F.col("n")).alias("t"), side(0, F.col("n")).alias("c"))
    # no more than MAX_ROWS / least texts' words can be there; in practice some hundreds
    return sorted(r.term for r in terms.where((F.col("t") >= least) & (lift >= MIN_LIFT)).select("term").collect())


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logistic weights, drawn to PRIOR by a ridge penalty; Newton steps.  n: how often each row counts."""
    x = np.column_stack([np.ones(len(x)), x])
    w, pull = PRIOR.copy(), strength * np.diag([0.01] + [1.0] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pull, x.T @ (n * (y - p)) - pull @ (w - PRIOR))
        w += step
        if np.abs(step).max() < 1e-9:
            break
    w[1:] = np.maximum(w[1:], 0)  # more matches never lower a score
    return w


def held_out(column="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(5)) == 0, F.lit(False))


def _share(most: int, found: int) -> int:
    """A threshold for hashes below 2**30 that about ``most`` of ``found`` rows pass; five deviations below it on average."""
    return int((most - 5 * most**0.5) / found * (1 << 30)) if found > most else 1 << 30


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], list[float]]:
    """Lexicon and weights from at most ``max_rows`` labelled rows outside the held-out fifth.

    Where a document's labels differ, one toxic label makes it toxic.  Null texts and labels teach nothing.
    """
    small = lambda found, *by: F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < _share(max_rows, found)
    labels = labels.where("toxic is not null and doc_id is not null").where(~held_out())
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    labels = labels.where(small(labels.count(), "doc_id"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(labels), "doc_id").where("text is not null")
    rows = rows.groupBy("doc_id", F.xxhash64("text").alias("t")).agg(F.first("text").alias("text"), F.first("toxic").cast("long").alias("toxic"), F.count("*").alias("n"))
    rows = rows.cache()
    try:
        found = rows.count()
        used = rows.where(small(found, "doc_id", "t")) if found > max_rows else rows  # repeated ids with many texts
        terms = learn_lexicon(used)
        if not found:
            return [], PRIOR.tolist()

        def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(terms)
            for b in batches:
                yield pa.record_batch({"toxic": b["toxic"], "n": b["n"]} | {n: pa.array(v) for n, v in zip(FEATURES, scorer.features(b["text"]).T)})

        # equal features with one label are one row: at most max_rows rows of seven numbers
        got = used.mapInArrow(featured, "toxic long, n long, " + ", ".join(f"{n} double" for n in FEATURES))
        got = got.groupBy("toxic", *FEATURES).agg(F.sum("n").alias("n")).toPandas()
    finally:
        rows.unpersist()
    got = got.sort_values(got.columns.tolist())
    return terms, fit(got[list(FEATURES)].to_numpy(), got["toxic"].to_numpy(float), got["n"].to_numpy(float)).tolist()


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs`` columns doc_id, held_out, score, predicted, strong, weak, mention (match counts).

    A null or empty text has no matches and the model's base score; without usable labels the prior weights and
    an empty lexicon apply, which predict 0.  Texts and single words of any length are read whole.  Repeated rows
    are scored each alike; other columns, whatever their names, are not read.
    """
    terms, weights = train(docs, labels, max_rows)
    return apply_scores(docs.select("doc_id", "text"), terms, weights).drop("text").select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "strong", "weak", "mention"
    )


def apply_scores(docs: DataFrame, terms: list[str], weights: list[float]) -> DataFrame:
    """``docs`` with score, strong, weak and mention added; clashing columns are replaced."""
    extra = ("score", "strong", "weak", "mention")
    docs = docs.drop(*extra)
    w = np.array(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms)
        for b in batches:
            x = scorer.features(b["text"])
            score = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            counts = np.rint(np.expm1(x[:, :3])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), *(pa.array(c) for c in counts.T)], [*b.schema.names, *extra])

    kinds = (T.DoubleType(), T.LongType(), T.LongType(), T.LongType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(extra, kinds))])
    return docs.mapInArrow(scored, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their own columns."""
    terms, weights = train(docs, labels, max_rows)
    return apply_scores(docs, terms, weights).where("score < 0.5").select(*docs.columns)
