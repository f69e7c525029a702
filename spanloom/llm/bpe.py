"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The words that the tokenizer's own vocabulary holds whole (plus any that the caller adds) are encoded once by
exact merging and compiled into a minimal acyclic automaton, in which equal suffixes are shared and the number of
words under each arc gives every word its index, hence its ids.  Its flat arrays are memory-mapped by the Python
workers.  Every other word is merged exactly: pairs in rank order, leftmost first.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMO = 120_000
END = "</w>"
LONG, NEVER = 64, 1 << 30
#: Marks that stand alone after a word of ASCII letters.
STOPS = frozenset(".,;:!?)")
_IDS, _TOKENS, _COUNT = map(itemgetter, range(3))
#: Fixed values of the tokenizer's format: how it cuts words, and what it takes for white space.
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
SPACE = regex.compile("[\t\n\v\f\r \x85\xa0  -     　]+")
ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: Ranges of code points that are younger than the library's tables of letters and numbers, which so
#: are neither to it, and the lower case of those capitals among them that its case table already has.
YOUNG_RANGES = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x1C89, 0x1C89), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CB, 0xA7CC), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DA, 0xA7DA), (0xA7DC, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10D50, 0x10D65), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
]
YOUNG_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{p: p + 0x20 for p in range(0x10D50, 0x10D66)}, **{p: p + 0x1B for p in range(0x16EA0, 0x16EB9)},
}
#: Ranges of combining marks that are younger than the library's normalisation tables, where they
#: are letters like any other: what they stand between is composed apart.
YOUNG_MARKS = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x1193D, 0x1193E), (0x11943, 0x11943),
    (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97),
    (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
MARKS = regex.compile("([" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in YOUNG_MARKS) + "])")
_YOUNG = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in YOUNG_RANGES)
YOUNG = regex.compile(f"[{_YOUNG}]")
CUT_YOUNG = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_YOUNG}]]+|[\p{{N}}--[{_YOUNG}]]|[[^\s\p{{L}}\p{{N}}]||[{_YOUNG}]]+")


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MinimalLexicon:
    """Minimal acyclic automaton over byte strings with word numbering, as flat arrays in a memory map."""

    @staticmethod
    def build(entries: dict[bytes, list[int]]) -> bytes:
        """The file image for word -> ids; words are added in order and each finished suffix is shared."""
        words = sorted(w for w in entries if w)
        register: dict[tuple, int] = {}
        nodes: list[tuple] = []  # (final, ((label, target), ...)), children before parents
        path: list[list] = [[False, []]]  # open nodes of the last word

        def freeze(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if key not in register:
                    register[key] = len(nodes)
                    nodes.append(key)
                parent = path[-1][1]
                parent[-1] = (parent[-1][0], register[key])

        last = b""
        for w in words:
            k = len(os.path.commonprefix([last, w]))
            freeze(k)
            for c in w[k:]:
                path[-1][1].append((c, -1))
                path.append([False, []])
            path[-1][0] = True
            last = w
        freeze(0)
        nodes.append((path[0][0], tuple(path[0][1])))
        below: list[int] = []
        first, labels, targets, skips = [0], [], [], []
        for final, arcs in nodes:
            total = int(final)
            for c, to in arcs:
                labels.append(c)
                targets.append(to)
                skips.append(total)
                total += below[to]
            below.append(total)
            first.append(len(labels))
        ids = [entries[w] for w in words]
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        parts = [first, [int(f) for f, _ in nodes], targets, skips, cuts, [i for x in ids for i in x], labels]
        arrays = [np.asarray(p, np.int32) for p in parts]
        return np.array([len(a) for a in arrays], np.int32).tobytes() + b"".join(a.tobytes() for a in arrays)

    def __init__(self, image: str | bytes):
        """image: a file's path, or its content, for which an anonymous map is made."""
        if isinstance(image, bytes):
            held = mmap.mmap(-1, len(image))
            held.write(image)
        else:
            with open(image, "rb") as f:
                held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(held).cast("i")
        at, parts = 7, []
        for n in view[:7]:
            parts.append(view[at : at + n])
            at += n
        self.first, self.final, self.targets, self.skips, self.cuts, self.ids, self.labels = parts
        self.root = len(self.final) - 1

    def get(self, word: bytes) -> list[int] | None:
        first, labels, node, index = self.first, self.labels, self.root, 0
        for c in word:
            hi = first[node + 1]
            arc = bisect_left(labels, c, first[node], hi)
            if arc == hi or labels[arc] != c:
                return None
            index += self.skips[arc]
            node = self.targets[arc]
        return self.ids[self.cuts[index] : self.cuts[index + 1]].tolist() if self.final[node] else None


class BpeCodec:
    """Encoder and decoder for a tokenizer file with word-end BPE, byte letters and special tokens."""

    def __init__(self, spec: dict, image: bytes | None = None):
        self.vocab, self.specials = spec["vocab"], spec["specials"]
        self.rank = {self.vocab[a] << 20 | self.vocab[b]: k for k, (a, b) in enumerate(spec["merges"])}
        self.product = [self.vocab[a + b] for a, b in spec["merges"]]
        self.letter, self.last = [self.vocab[c] for c in byte_letters()], [self.vocab[c + END] for c in byte_letters()]
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.lexicon = MinimalLexicon(image) if image is not None else None
        self.name = {i: str(i) for i in self.token}
        self.young: dict = {}
        self.old: dict = {}
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(keys)
        self.sorted_keys, self.sorted_ranks = np.append(keys[order], 1 << 62), np.append(order, NEVER)
        self.letters, self.lasts, self.products = (np.array(x, np.int64) for x in (self.letter, self.last, self.product))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word by exact merging: always the pair of lowest rank, leftmost first."""
        letter = self.letter
        parts = [letter[b] for b in word]
        parts[-1] = self.last[word[-1]]
        if len(parts) > LONG:
            return self._merge_long(parts)
        rank, product = self.rank.get, self.product
        ranks = [rank(a << 20 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != NEVER:
            k = ranks.index(low)
            parts[k : k + 2] = [product[low]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank(parts[k - 1] << 20 | parts[k], NEVER)
            if k < len(ranks):
                ranks[k] = rank(parts[k] << 20 | parts[k + 1], NEVER)
        return parts

    def _merge_long(self, parts: list) -> list[int]:
        """The same with a heap of pairs over a linked list, so that long words stay near-linear."""
        n = len(parts)
        rank, after, before = self.rank, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k, p in enumerate(zip(parts, parts[1:])) if (r := rank.get(p[0] << 20 | p[1])) is not None]
        heapq.heapify(heap)
        while heap:
            low, k = heapq.heappop(heap)
            j = after[k] if parts[k] is not None else n
            if j >= n or rank.get(parts[k] << 20 | parts[j]) != low:
                continue  # a stale pair
            parts[k], parts[j] = self.product[low], None
            after[k] = m = after[j]
            if m < n:
                before[m] = k
                if (r := rank.get(parts[k] << 20 | parts[m])) is not None:
                    heapq.heappush(heap, (r, k))
            if (b := before[k]) >= 0 and (r := rank.get(parts[b] << 20 | parts[k])) is not None:
                heapq.heappush(heap, (r, b))
        return [p for p in parts if p is not None]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = np.where((a < 0) | (b < 0), -1, a << 20 | b)
        at = np.searchsorted(self.sorted_keys, keys)
        return np.where(self.sorted_keys[at] == keys, self.sorted_ranks[at], NEVER)

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """``merge`` of many words at once: one matrix for each range of lengths, one merge a word and step."""
        out: list = [None] * len(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        for lo, hi in zip((0, 4, 8, 12, 16, 24, 40), (4, 8, 12, 16, 24, 40, LONG)):
            rows = np.flatnonzero((length > lo) & (length <= hi))
            if not len(rows):
                continue
            data = np.frombuffer(b"".join([words[r].ljust(hi, b"\0") for r in rows]), np.uint8).reshape(-1, hi)
            n, col = length[rows], np.arange(hi)
            ids = np.where(col < n[:, None], self.letters[data], -1)
            ids[np.arange(len(rows)), n - 1] = self.lasts[data[np.arange(len(rows)), n - 1]]
            ranks = np.append(self._ranks(ids[:, :-1], ids[:, 1:]), np.full((len(rows), 1), NEVER), 1)
            while len(rows):
                at = ranks.argmin(1)
                each = np.arange(len(rows))
                low = ranks[each, at]
                done = low == NEVER
                if done.any():
                    for r, x, k in zip(rows[done], ids[done].tolist(), (ids[done] >= 0).sum(1).tolist()):
                        out[r] = x[:k]
                    go = ~done
                    rows, ids, ranks, at, low = rows[go], ids[go], ranks[go], at[go], low[go]
                    each = np.arange(len(rows))
                    if not len(rows):
                        break
                width = ids.shape[1]
                past = np.arange(width) > at[:, None]
                ids = np.where(past, np.append(ids[:, 1:], np.full((len(rows), 1), -1), 1), ids)
                past[each, at] = True
                ranks = np.where(past, np.append(ranks[:, 1:], np.full((len(rows), 1), NEVER), 1), ranks)
                ids[each, at] = self.products[low]
                left = at > 0
                ranks[each[left], at[left] - 1] = self._ranks(ids[each[left], at[left] - 1], ids[each[left], at[left]])
                right = np.minimum(at + 1, width - 1)
                ranks[each, at] = np.where(at + 1 < width, self._ranks(ids[each, at], ids[each, right]), NEVER)
        for r in np.flatnonzero(length > LONG):
            out[r] = self.merge(words[r])
        return out

    def _learn(self, chunks: set) -> dict:
        """A table that has (ids text, tokens text, count) of each of the distinct runs without white space and special tokens.

        What was seen lately is kept, in two generations of about MEMO each; when the younger is full it becomes
        the older, which is then forgotten but for what is asked again.
        """
        if len(self.young) >= MEMO:
            self.old, self.young = self.young, {}
        young, old, cuts, unseen = self.young, self.old, {}, {}
        for c in chunks.difference(young):
            value = old.get(c)
            if value is not None:
                young[c] = value
                continue
            if type(c) is tuple:
                young[c] = (str(c[0]), c[1], 1)
                continue
            if c.isascii():
                low = c.lower()
                if low.isalpha():
                    words = (low.encode(),)
                elif low[-1] in STOPS and low[:-1].isalpha():
                    words = (low[:-1].encode(), low[-1].encode())
                else:
                    words = [w.encode() for w in CUT.findall(low)]
            else:
                # lower case letter by letter: sigma has no final form here
                low = c.replace("Σ", "σ").lower()
                words = [w.encode() for w in (CUT.findall(low) if not YOUNG.search(low) else CUT_YOUNG.findall(low.translate(YOUNG_LOWER)))]
            cuts[c] = words
            for w in words:
                unseen[w] = None
        if self.lexicon:
            get = self.lexicon.get
            for w in unseen:
                unseen[w] = get(w)
        rest = [w for w, ids in unseen.items() if ids is None]
        unseen.update(zip(rest, self.merge_many(rest)))
        token, name = self.token, self.name
        for c, words in cuts.items():
            ids = unseen[words[0]] if len(words) == 1 else [i for w in words for i in unseen[w]]
            young[c] = (name[ids[0]], token[ids[0]], 1) if len(ids) == 1 else (" ".join([name[i] for i in ids]), " ".join([token[i] for i in ids]), len(ids))
        return young

    def pieces(self, text: str) -> list:
        """The text's runs without white space, and (id, content) of its special tokens, in order."""
        out: list = []
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                out.append((self.specials[part], part))
            elif part:
                if not unicodedata.is_normalized("NFC", part):
                    part = "".join([unicodedata.normalize("NFC", x) for x in MARKS.split(part)])
                out += filter(None, SPACE.split(part)) if ODD_SPACE.search(part) else part.split()
        return out

    def encode_many(self, texts: list[str]) -> Iterator[tuple[str, str, int]]:
        """For each text the ids joined by spaces, the decoded text and the number of tokens."""
        runs = list(map(self.pieces, texts))
        known = self._learn(set().union(*runs)).__getitem__
        for x in runs:
            got = list(map(known, x))
            counts = list(map(_COUNT, got))
            if 0 in counts:
                got = [v for v in got if v[2]]
            yield " ".join(map(_IDS, got)), " ".join(map(_TOKENS, got)), sum(counts)

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.encode_many([text]) for i in ids.split()]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space: the file names no decoder."""
        return " ".join(self.token[i] for i in ids)


def load_spec(path: str) -> dict:
    """Vocabulary, merges and special tokens of a tokenizer file of this kind; ValueError for another kind."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    model = j["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or j.get("decoder") is not None:
        raise ValueError(f"{path} is not a word-end BPE file without a decoder")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": merges, "specials": {t["content"]: t["id"] for t in j["added_tokens"]}}


def lexicon_image(spec: dict, words: Iterable[str] = ()) -> bytes:
    """The transducer of the vocabulary's whole words and of ``words``."""
    codec, back = BpeCodec(spec), {c: b for b, c in enumerate(byte_letters())}
    keys = {bytes(back[c] for c in t[: -len(END)]) for t in spec["vocab"] if t.endswith(END) and len(t) > len(END)}
    keys |= {w.encode() for w in words if w}
    return MinimalLexicon.build({k: codec.merge(k) for k in keys})


def _slices(column: pa.Array, most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in runs of about ``most`` characters."""
    texts, size = [], 0
    for value in column:
        text = value.as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= most:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


_codecs: dict[str, BpeCodec] = {}


def bpe_columns(docs: DataFrame, path: str, *, words: Iterable[str] = (), ids: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 (and with ids=True the ids); clashing columns are replaced.

    Null texts count as empty.  The vocabulary and the transducer, whose sizes are the file's, go to each worker
    once, and to the task as a broadcast.
    """
    extra = ("n_tokens", "ids_sha256", "decoded_sha256", *(("ids",) if ids else ()))
    docs = docs.drop(*extra)
    spec = load_spec(path)
    shipped = docs.sparkSession.sparkContext.broadcast((spec, lexicon_image(spec, words)))
    name = sha256(shipped.value[1]).hexdigest()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _codecs:
            _codecs.clear()
            _codecs[name] = BpeCodec(*shipped.value)
        codec = _codecs[name]
        for batch in batches:
            counts, first, second, lists = [], [], [], []
            for texts in _slices(batch["text"]):
                for joined, decoded, n in codec.encode_many(texts):
                    counts.append(n)
                    first.append(sha256(joined.encode()).hexdigest())
                    second.append(sha256(decoded.encode()).hexdigest())
                    if ids:
                        lists.append(np.array(joined.split(), np.int32))
            columns = [pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            if ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *extra])

    kinds = (T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(encoded, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(extra, kinds))]))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return bpe_columns(docs.select(F.col("doc_id").cast("long"), "text"), path).drop("text")
