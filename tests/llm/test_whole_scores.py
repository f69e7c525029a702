"""The two fitted scorers over whole tables against plain computations from their definitions."""

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import brown_lm, registry, toxicity
from spanloom.llm.text_kernel import hashed_texts

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = re.compile("[\x20\x09-\x0d]+")


def words_of(text):
    return [w for w in SPACES.split(text or "") if w]


# language model ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("near", [1 << 17, 2000])
def test_language_model_scores_equal_the_formula(spark, monkeypatch, near):
    """All class sums, class bigrams and word counts in plain Python; only the classes themselves are taken from the fit."""
    kept, make = {}, brown_lm.Classes.__init__
    monkeypatch.setattr(brown_lm, "NEAR", near)
    monkeypatch.setattr(brown_lm.Classes, "__init__", lambda self, *a: (kept.setdefault("classes", self), make(self, *a))[1])
    found = {r.doc_id: r for r in registry.op6_brown_lm(spark, FOLDER).collect()}
    c = kept["classes"]
    of = dict(zip(c.known.tolist(), c.of.tolist()))

    @lru_cache(None)
    def class_of(word):
        h = int(next(hashed_texts(pa.array([word])))[1][0])
        last = word.encode()[-2:]
        ending = (last[-1] * 257 + (last[0] if len(last) > 1 else 0)) * 2654435761 % 4294967291 % brown_lm.ENDINGS
        return of.get(h, int(c.endings[ending]))

    rows = {r.doc_id: words_of((r.text or "").translate(LOWER)) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    assert set(rows) == set(found)
    training = [rows[i] for i, r in found.items() if not r.held_out]
    counts = Counter(w for t in training for w in t)
    k = int(max(c.of.max(initial=0), c.endings.max(), c.end, c.start)) + 1
    mass, kinds, table = np.zeros(k), np.zeros(k), np.zeros((k, k))
    for w, n in counts.items():
        mass[class_of(w)] += n
        kinds[class_of(w)] += 1
    mass[c.end], kinds[c.end] = len(training), 1
    for t in training:
        path = [c.start, *map(class_of, t), c.end]
        for a, b in zip(path, path[1:]):
            table[a, b] += 1
    share = mass + 0.5
    share[c.start] = 0
    share /= share.sum()
    for i, t in rows.items():
        path, score = [c.start, *map(class_of, t), c.end], 0.0
        for a, b, n in zip(path, path[1:], [*(counts[w] for w in t), len(training)]):
            score += math.log10((table[a, b] + 4 * share[b]) / (table[a].sum() + 4)) + math.log10((n + 0.5) / (mass[b] + 0.5 * (kinds[b] + 1)))
        assert found[i].score == pytest.approx(score, abs=1e-6, rel=1e-9)
        assert found[i].perplexity == pytest.approx(10 ** (-score / (len(t) + 1)), rel=1e-6)


# toxicity ----------------------------------------------------------------------------------------------------


def distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        if min(row) > most:
            return most + 1
    return row[-1]


def plain_kind(terms):
    """0, 1 or 2 for a word, by distances to every term."""
    bound = {t: 2 if len(t) >= 8 else 1 if len(t) >= 4 else 0 for t in terms}

    def nearest(word):
        return min((d for t, m in bound.items() if abs(len(t) - len(word)) <= m and (d := distance(word, t, m)) <= m), default=9)

    def core(word):
        found = re.search(r"\w(?:.*\w)?", word, re.S)
        return found[0] if found else ""

    def runs(word):
        return [(m[1], len(m[0])) for m in re.finditer(r"(.)\1*", word, re.S)]

    def whole(word):
        own = core(word)
        if not own:
            return 0
        near = nearest(own)
        if near == 0:
            return 2
        mine = runs(own)
        if any(n > 1 for _, n in mine):
            for t in terms:
                other = runs(t)
                if [c for c, _ in other] == [c for c, _ in mine] and all(a >= b for (_, a), (_, b) in zip(mine, other)):
                    return 2
        if re.search(r"[\W\d_]", word):
            plain = nearest(core(word.strip(".,;:?()[]{}" + toxicity.QUOTES).translate(toxicity.PLAIN)))
            if plain == 0 or plain == 1 and re.search(r"[\W\d_]", own):
                return 2
        return 1 if near < 9 else 0

    @lru_cache(None)
    def kind(word):
        word = word.lower()
        best = max([whole(word), *(whole(p) for p in re.split(r"[^\w*@$!|#%]+|_+", word) if p)])
        for run in re.findall(f"[{toxicity._ALONE}]+", word):
            if any(t in run for t in terms):
                return 2
        return best

    return kind


def test_toxicity_scores_equal_the_definition(spark):
    """Lexicon and weights from the fit; every word's kind, the windows, features and scores in plain Python."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    terms, weights = toxicity.train(docs, labels)
    assert terms
    kind, end = plain_kind(terms), ".,;:!?"
    for r in registry.op5_toxicity(spark, FOLDER).join(docs.select("doc_id", "text"), "doc_id").collect():
        words, n = words_of(r.text), [0, 0, 0]
        for i, w in enumerate(words):
            k = kind(w)
            if not k:
                continue
            before, after = words[max(0, i - 5) : i], words[i + 1 : i + 6]
            opened = w[0] in toxicity.QUOTES or any(x[0] in toxicity.QUOTES and x[-1] not in toxicity.QUOTES for x in before)
            closed = w.rstrip(end)[-1:] in toxicity.QUOTES and w.rstrip(end) != "" or any(x.rstrip(end)[-1:] in toxicity.QUOTES for x in after)
            said = any(x.strip(end).lower() in toxicity.REPORTING for x in before[-2:])
            n[2 if opened and closed or said else 0 if k == 2 else 1] += 1
        assert (r.strong, r.weak, r.mention) == tuple(n), r.doc_id
        x = [*(math.log1p(v) for v in n), float(n[0] > 0), math.log1p(100 * n[0] / max(len(words), 1))]
        score = 1 / (1 + math.exp(-(weights[0] + sum(a * b for a, b in zip(x, weights[1:])))))
        assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == (score >= 0.5)
