"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, verified edit similarity, one line a group.

Texts and lines of any length are read whole.  A line's normal form is lower case with every run of other characters than letters and digits as one space.
Lines with at least ``LEAST`` words take part.  Two of them are linked if their 64-bit SimHashes, over all
words (``WHOLE``; by default distinct ones of at least ``LONG_WORD`` bytes), differ in at most ``BITS`` bits and their normal forms' edit similarity is
at least ``PERCENT``.  With ``BLOCKS`` blocks, such hashes agree on ``BLOCKS - BITS`` of them, so each choice of so
many blocks is a bucket key: no pair is missed, whatever ``BLOCKS`` is.  More blocks give longer keys, hence fewer
chance meetings, for more rows a line: five serve some hundred million distinct lines, six some billions.  Of each
connected group the first occurrence, by (doc_id, line number), stays.

So few bits miss most lines with a changed word, and pigeonhole keys for more are too short to be selective.  With
``bands`` (``WHOLE``) the bucket keys are min-hashes over the line's neighbouring words instead, two of disjoint
halves in a key, and the SimHash bound, set by measured recall, only spares comparisons.  A pair of Jaccard
similarity J over neighbouring words meets with a chance of about 1 - (1 - J * J) ** bands.  In scripts written
without spaces each letter is a word here.  ``WHOLE`` lets every line with a normal form take part; those of fewer
than ``letters`` letters and digits are grouped with their exact repeats only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linking import link_buckets
from .shared import checked_broadcast, drop, stash
from .text_kernel import hashed_texts, mix64, text_chunks, word_hashes, word_spans

BITS, BLOCKS, PERCENT, LEAST, LONG_WORD = 3, 5, 90, 5, 4
#: Options of the registered query and of the pipeline.
WHOLE = {"every": True, "bits": 24, "bands": 12, "least": 1, "letters": 20}
_FIRST = -(1 << 63)
THREE_BINS, BLOCK_LINES, SEEN = 1024, 3000, 500_000
#: Cells that a step of the batched edit distance takes, the longest lines it takes, and steps after which it drops pairs that are too far apart.
CELLS, LONG_LINE, STEPS = 1 << 13, 10_000, 32


class _Letters(dict):
    """Code point to itself for letters and digits, to a space for all others but the line end; filled as asked."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = c = c if c.isalnum() or c == "\n" else " "
        return c


_LETTERS = _Letters()


def normal(line: str) -> str:
    """The line's normal form."""
    return " ".join(line.lower().translate(_LETTERS).split())


#: For each code point 1 if it becomes a space in a normal form, 0 if it stays, 2 if nobody has asked yet.
_SPACES = np.full(0x110000, 2, np.uint8)


def normal_lines(text: str) -> list[str]:
    """``normal`` of each of a text's lines."""
    text = text.lower()
    if text.isascii():  # ``translate`` has a fast way for these only
        text = text.translate(_LETTERS)
    else:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        kind = _SPACES[code]
        if kind.max(initial=0) > 1:
            new = np.unique(code[kind > 1])
            _SPACES[new] = [_LETTERS[p] == " " for p in new.tolist()]
            kind = _SPACES[code]
        code[kind > 0] = 32
        text = code.tobytes().decode("utf-32-le", "surrogatepass")
    return [" ".join(x.split()) for x in text.split("\n")]


#: Letters of scripts without spaces: Thai to Myanmar, Khmer, kana, Han.
_ALONE = re.compile("[\u0e00-\u109f\u1780-\u17ff\u3040-\u312f\u31a0-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def units(form: str) -> str:
    """The form with spaces about each letter of scripts without spaces, which are words of their own."""
    return form if form.isascii() else _ALONE.sub(r" \g<0> ", form)


def line_id(form: str) -> int:
    return int.from_bytes(blake2b(form.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


#: For each byte its eight bits, lowest first, as the eight bytes of a number.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _vote(words: np.ndarray, line: np.ndarray, out: np.ndarray) -> None:
    """Bit by bit the majority over each line's word hashes, into out[line]; words come line by line.

    Bits are counted in byte lanes, eight at once, by runs of at most 255 words; lines with more words are several runs.
    """
    if not len(words):
        return
    begin = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    n = np.diff(np.append(begin, len(line)))
    runs = -(-n // 255)
    skip = np.cumsum(runs) - runs
    cut = np.repeat(begin, runs) + 255 * (np.arange(runs.sum()) - np.repeat(skip, runs))
    major = np.empty((len(begin), 64), np.uint8)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[(words >> np.uint64(8 * k)) & np.uint64(255)], cut).view(np.uint8).reshape(-1, 8).astype(np.int64)
        if len(cut) != len(begin):
            lanes = np.add.reduceat(lanes, skip, axis=0)
        major[:, 8 * k : 8 * k + 8] = 2 * lanes > n[:, None]
    out[line[begin]] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()


def simhashes(forms: list[str], every: bool = False) -> np.ndarray:
    """One 64-bit SimHash a line, as int64: bit by bit the majority over its distinct longer words' hash bits, or
    with every=True over all its words.

    Words of fewer than ``LONG_WORD`` bytes, and repetitions, do not vote: the few very frequent words that most
    lines of a language share are short, and would otherwise make unlike lines' hashes alike.  Only lines with
    fewer than three longer words use all.
    """
    out = np.zeros(len(forms), np.uint64)
    with np.errstate(over="ignore"):
        for row, raw, offsets in text_chunks(pa.array(forms, pa.large_string())):
            starts, ends, first = word_spans(raw, offsets)
            words, line = word_hashes(raw, starts, ends), np.repeat(np.arange(len(first) - 1), np.diff(first))
            if not every:
                votes = ends - starts >= LONG_WORD
                few = np.bincount(line[votes], minlength=len(first) - 1) < 3
                votes |= few[line]
                words, line = words[votes], line[votes]
                order = np.lexsort((words, line))
                words, line = words[order], line[order]
                new = np.ones(len(words), bool)
                new[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
                words, line = words[new], line[new]
            _vote(words, line, out[row:])
    return out.view(np.int64)


def _least(words: np.ndarray, first: np.ndarray, bands: int) -> np.ndarray:
    """``band_keys`` of lines with these word hashes, as uint32; in parts that stay in the processor's cache."""
    n = len(first) - 1
    out = np.zeros((n, bands), np.uint32)
    cuts = first + np.arange(n + 1)
    own = np.zeros(len(words) + n, np.uint64)
    own[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(first))] = mix64(words)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[cuts[:-1]] = 0
    pairs = mix64(before * np.uint64(0x9E3779B97F4A7C15) + own)
    odd = mix64(np.arange(1, bands + 1, dtype=np.uint64)) | np.uint64(1)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + 8192, "right")) - 1)
        part, at = pairs[cuts[lo] : cuts[hi]], cuts[lo:hi] - cuts[lo]
        for b in range(bands):
            h = part * odd[b]
            h ^= h >> np.uint64(32)
            side = -((part >> np.uint64(b % 64)) & np.uint64(1))  # all bits or none
            low, high = np.minimum.reduceat(h | ~side, at), np.minimum.reduceat(h | side, at)
            out[lo:hi, b] = mix64(mix64(low) + high) >> np.uint64(32)
        lo = hi
    return out


def band_keys(forms: list[str], bands: int) -> np.ndarray:
    """``bands`` 32-bit values a line, as int32: each of the least hashes of two halves of its neighbouring words.

    The line's start and end count as words.  Halves differ from band to band; an empty half has one fixed value.
    """
    out = np.zeros((len(forms), bands), np.uint32)
    with np.errstate(over="ignore"):
        for row, words, first in hashed_texts(pa.array(forms, pa.large_string())):
            out[row : row + len(first) - 1] = _least(words, first, bands)
    return out.view(np.int32)


def _signed(forms: list[str], bands: int) -> tuple[np.ndarray, np.ndarray]:
    """``simhashes`` over all words and ``band_keys``, from word hashes made once."""
    sims, keys = np.zeros(len(forms), np.uint64), np.zeros((len(forms), bands), np.uint32)
    with np.errstate(over="ignore"):
        for row, words, first in hashed_texts(pa.array(forms, pa.large_string())):
            n = len(first) - 1
            _vote(words, np.repeat(np.arange(n), np.diff(first)), sims[row : row + n])
            keys[row : row + n] = _least(words, first, bands)
    return sims.view(np.int64), keys.view(np.int32)


def _common(a: str, b: str, i: int, j: int) -> int:
    """How many characters agree from a[i] and b[j] on."""
    n, step = 0, 16
    while a[i + n : i + n + step] == b[j + n : j + n + step]:
        if not a[i + n : i + n + step]:
            return n
        n += step
        step *= 2
    while step > 1:  # the slices of length step differ or one is at its end
        step //= 2
        if a[i + n : i + n + step] == b[j + n : j + n + step] and len(a) >= i + n + step and len(b) >= j + n + step:
            n += step
    return n


def _few_edits(a: str, b: str, most: int) -> int | None:
    """Levenshtein distance if it is at most ``most``: for each number of edits how far each diagonal reaches."""
    shift, reach = len(b) - len(a), {0: _common(a, b, 0, 0)}
    if reach[0] >= len(a) and not shift:
        return 0
    for d in range(1, most + 1):
        now = {}
        for k in range(-d, d + 1):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -1), reach.get(k + 1, -2) + 1)
            i = min(i, len(a), len(b) - k)
            if i < 0 or i + k < 0:
                continue
            i += _common(a, b, i, i + k)
            if k == shift and i >= len(a):
                return d
            now[k] = i
        reach = now
    return None


def _columns(a: str, b: str, most: int) -> int:
    """Levenshtein distance by bit-parallel columns; any larger number where it is larger than ``most``."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    places: dict[str, int] = {}
    bit = 1
    for c in a:
        places[c] = places.get(c, 0) | bit
        bit <<= 1
    full, top = bit - 1, bit >> 1
    up, down, score, left, get = full, 0, len(a), len(b) - 1, places.get
    for c in b:
        eq = get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(x | up)), up & x
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score - left > most:
            return most + 1
        left -= 1
        plus, x = plus << 1 | 1, eq | down
        up, down = (minus << 1 | ~(x | plus)) & full, plus & x & full
    return score


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance; with ``most`` any larger number where it is larger than that."""
    if a == b:
        return 0
    most = len(a) + len(b) if most is None else most
    few = _few_edits(a, b, min(2, most))
    if few is not None:
        return few
    lo = _common(a, b, 0, 0)
    a, b = a[lo:], b[lo:]
    hi = _common(a[::-1], b[::-1], 0, 0)
    return _columns(a[: len(a) - hi], b[: len(b) - hi], most)


def _enough(a: str, b: str, most: int) -> int:
    """An upper bound of the distance: words in order, unequal ones against each other, as long as it is within ``most``."""
    x, y = a.split(" "), b.split(" ")
    i = j = cost = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        after = x[i + 1] if i + 1 < len(x) else None
        if after == y[j] and (j + 1 == len(y) or after is not None):
            cost, i = cost + len(x[i]) + 1, i + 1
        elif j + 1 < len(y) and y[j + 1] == x[i]:
            cost, j = cost + len(y[j]) + 1, j + 1
        else:
            cost, i, j = cost + _columns(x[i], y[j], most), i + 1, j + 1
        if cost > most:
            return cost
    return cost + sum(len(w) + 1 for w in x[i:]) + sum(len(w) + 1 for w in y[j:])


def similar(a: str, b: str, percent: int = PERCENT) -> bool:
    """Whether the edit similarity is ``percent`` at least."""
    allowed = max(len(a), len(b)) * (100 - percent) // 100
    return abs(len(a) - len(b)) <= allowed and (_enough(a, b, allowed) <= allowed or edit_distance(a, b, allowed) <= allowed)


def _codes(texts: list[str], at: np.ndarray, rows: int, fill: int) -> np.ndarray:
    """Code points, one text a column from row ``at`` on; other cells are ``fill``."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((rows, len(texts)), fill, np.uint32)
    row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + at
    out[row, np.repeat(np.arange(len(texts)), n)] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _batch(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """``within`` for texts of like lengths, a[i] no longer than b[i], by antidiagonals of the distance table.

    Cells (i, j) of one i + j depend only on those of the two sums before, so all of them, of all pairs, are one step.
    A path of at most ``most`` edits stays between the diagonals j - i of -low and high.
    """
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.zeros(len(a), bool)
    shift, last = lb - la, int((la + lb).max())
    low, high = int(((most - shift) // 2).max()), int(((most + shift) // 2).max())
    low, high = low + low % 2, high + high % 2
    n, pad = (low + high) // 2 + 1, (low + high) // 2 + 4
    rows = 2 * pad + (last + low + high) // 2
    x, y = _codes(a, pad, rows, 0x110000)[::-1], _codes(b, pad, rows, 0x110001)
    if max(x[x < 0x110000].max(initial=0), y[y < 0x110000].max(initial=0)) >= 0xFFF0:
        values, both = np.unique(np.concatenate([x, y]), return_inverse=True)
        x, y = both.reshape(2, rows, -1)
        if len(values) > 0xFFFF:
            return np.array([edit_distance(p, q, int(m)) <= m for p, q, m in zip(a, b, most)])
    x, y = np.ascontiguousarray(x.astype(np.uint16)), y.astype(np.uint16)
    # rows of even diagonals -low, -low + 2, ...; rows of odd ones between them, within a border
    even, odd = np.full((n, len(a)), 30_000, np.uint16), np.full((n + 1, len(a)), 30_000, np.uint16)
    even[low // 2] = 0
    cost = np.empty_like(even)
    live = np.arange(len(a))
    ahead = [np.abs(shift - np.arange(-low + d, high + 1, 2)[:, None]).astype(np.uint16) for d in (0, 1)]
    ends = set((la + lb).tolist())
    for t in range(last + 1):
        if t:
            j, i = (t - low + 1) // 2, (t + low) // 2
            own, m = (odd[1:-1], n - 1) if t % 2 else (even, n)
            unlike = np.bitwise_xor(x[rows - i - pad : rows - i - pad + m], y[j - 1 + pad : j - 1 + pad + m], out=cost[:m])
            np.minimum(unlike, 1, out=unlike)
            unlike += own
            np.minimum(*((even[:-1], even[1:]) if t % 2 else (odd[:-1], odd[1:])), out=own)
            own += 1
            np.minimum(own, unlike, out=own)
        if t in ends:
            p = np.flatnonzero((la + lb)[live] == t)
            s = shift[live[p]]
            out[live[p]] = (odd[1 + (s + low) // 2, p] if t % 2 else even[(s + low) // 2, p]) <= most[live[p]]
        if t % STEPS == STEPS - 1:
            least = (even + ahead[0]).min(0)
            if n > 1:
                least = np.minimum(least, (odd[1:-1] + ahead[1]).min(0))
            on = (least <= most[live]) & ((la + lb)[live] > t)
            if not on.any():
                break
            if 2 * on.sum() <= len(live):
                live = live[on]
                even, odd, x, y, *ahead = (np.compress(on, h, axis=1) for h in (even, odd, x, y, *ahead))
                cost = np.empty_like(even)
    return out


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether each pair's Levenshtein distance is at most ``most``: exact, many pairs of like lengths at a time."""
    a, b = [min(p, key=len) for p in zip(a, b)], [q if len(p) <= len(q) else p for p, q in zip(a, b)]
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.zeros(len(a), bool)
    near = np.flatnonzero(lb - la <= most)
    for i in near[lb[near] > LONG_LINE]:
        out[i] = edit_distance(a[i], b[i], int(most[i])) <= most[i]
    near = near[lb[near] <= LONG_LINE]
    near = near[np.lexsort((la[near] + lb[near], most[near]))]
    at = 0
    while at < len(near):
        to = at + max(1, min(512, CELLS // (int(most[near[at]]) // 2 + 1)))
        part = near[at:to]
        out[part] = _batch([a[i] for i in part], [b[i] for i in part], most[part])
        at = to
    return out


def _threes(forms: list[str]) -> np.ndarray:
    """For each form how many of its runs of three letters fall into each of ``THREE_BINS`` bins, 255 at most."""
    out = np.zeros((len(forms), THREE_BINS), np.uint8)
    for lo in range(0, len(forms), 512):
        part = forms[lo : lo + 512]
        code = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(part)), np.fromiter(map(len, part), np.int64, len(part)))
        inner = row[2:] == row[:-2]
        bins = ((code[:-2] * np.uint32(2654435761) ^ code[1:-1] * np.uint32(2246822519)) * np.uint32(3266489917) ^ code[2:] * np.uint32(668265263)) * np.uint32(2654435761) >> np.uint32(22)
        counts = np.bincount(row[2:][inner] * THREE_BINS + bins[inner], minlength=len(part) * THREE_BINS)
        out[lo : lo + 512] = np.minimum(counts, 255).reshape(-1, THREE_BINS)
    return out


def _alike(la, ta, lb, tb, percent: int) -> np.ndarray:
    """Rows that may be similar: an edit changes at most six counts of runs of three letters by one, so no pair is lost."""
    allowed = np.maximum(la, lb) * (100 - percent) // 100
    return (np.maximum(ta, tb) - np.minimum(ta, tb)).sum(1, dtype=np.int64) <= 6 * allowed


def _odd(threes: np.ndarray) -> np.ndarray:
    """The counts' lowest bits: where these differ in more than six places an edit, the counts do as well."""
    return np.packbits(threes & 1, axis=1).view(np.uint64)


def _line_rows(least: int, every: bool, bands: int, letters: int):
    """Occurrences of the lines that take part: (k, pos, id), and with a line's first in the task (sim, bands, form)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, len(batch["text"]), 256):
                part = batch.slice(lo, 256)
                keys, places, ids, fresh = [], [], [], {}
                if len(seen) > SEEN:
                    seen.clear()  # what is asked again is only given again
                for k, text in zip(part["k"].to_pylist(), part["text"]):
                    for pos, form in enumerate(normal_lines(text.as_py() or "")):
                        if form and form.count(" ") >= least - 1:
                            i = line_id(form)
                            if i not in seen:
                                seen.add(i)
                                fresh[len(ids)] = form
                            keys.append(k)
                            places.append(pos)
                            ids.append(i)
                forms = list(fresh.values())
                fuzzy = np.array([len(f) - f.count(" ") >= letters for f in forms], bool)
                words = [units(f) for f, x in zip(forms, fuzzy) if x] if bands else forms
                sim, at = np.zeros(len(forms), np.int64), np.full(len(ids), -1)
                if bands and every:
                    sim[fuzzy], values = _signed(words, bands)
                elif bands:
                    sim[fuzzy], values = simhashes(words), band_keys(words, bands)
                else:
                    sim, values = simhashes(words, every), np.zeros(0, np.int32)
                at[list(fresh)] = np.arange(len(forms))
                take = pa.array(at, mask=at < 0)
                ends = pa.array(np.append(0, np.cumsum(fuzzy * bands)).astype(np.int32))
                keyed = pa.ListArray.from_arrays(ends, pa.array(values.ravel()))
                yield pa.record_batch({
                    "k": pa.array(keys, pa.int64()), "pos": pa.array(places, pa.int32()), "id": pa.array(ids, pa.int64()),
                    "sim": pa.array(sim, pa.int64()).take(take), "size": pa.array(list(map(len, forms)), pa.int32()).take(take), "bands": keyed.take(take),
                    "form": pa.array([f if x else None for f, x in zip(forms, fuzzy)], pa.string()).take(take),
                })

    return rows


def _meetings(bits: int, percent: int):
    """Sorted (key, id, sim, size) to each bucket's (hub, other member): whether they are near in bits and length, and whether the bucket
    has more members, whose pairs have then still to be looked at.  A far pair that is a whole bucket has no row.

    Of a bucket that goes on in the next batch only the hub, and a second member that may be the last, are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)  # hub, then perhaps a second member
        large = False  # whether the held bucket has had three members

        def rows(block: np.ndarray, sizes: np.ndarray, hub: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            near = np.bitwise_count((block[own, 2] ^ block[hub, 2]).view(np.uint64)) <= bits
            near &= np.abs(block[own, 3] - block[hub, 3]) <= np.maximum(block[own, 3], block[hub, 3]) * (100 - percent) // 100
            more = sizes >= 3
            take = near | more
            return pa.record_batch({
                "key": pa.array(block[own, 0][take]), "a": pa.array(block[hub, 1][take]), "b": pa.array(block[own, 1][take]),
                "near": pa.array(near[take]), "more": pa.array(more[take]),
            })

        for b in batches:
            block = np.concatenate([held, np.column_stack([b[c].to_numpy() for c in ("key", "id", "sim", "size")])])
            if not len(block):
                continue
            new = np.append(True, block[1:, 0] != block[:-1, 0])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(block)))
            if large and len(held):
                sizes[0] = max(sizes[0], 3)
            run_of = np.cumsum(new) - 1
            own = np.flatnonzero(~new)
            last = len(starts) - 1
            open_two = sizes[last] == 2 and len(block) - starts[last] == 2
            if open_two:
                own = own[own != len(block) - 1]
            if len(own):
                yield rows(block, sizes[run_of[own]], starts[run_of[own]], own)
            large = bool(sizes[last] >= 3)
            held = block[starts[last] : starts[last] + (2 if open_two else 1)].copy()
        if len(held) == 2:
            yield rows(held, np.array([2]), np.array([0]), np.array([1]))

    return run


def _pairs(group: np.ndarray, is_q: np.ndarray, is_x: np.ndarray, length: np.ndarray, percent: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (q, x) of each group's pairs, but for those whose lengths alone tell them apart, query by query, in runs of about ``most``; a run ends with a whole query.

    Rows come sorted by (group, length), so a query's possible partners stand together.
    """
    x = np.flatnonzero(is_x)
    top = int(length.max(initial=0)) + 1
    place = group.astype(np.int64) * top
    least = length - length * (100 - percent) // 100
    longest = np.minimum((length + 1) * 100 // percent + 1, top - 1)  # the most for which the longer one may still be cut to this length
    own = (place + length)[x]
    lo, hi = np.searchsorted(own, place + least, "left"), np.searchsorted(own, place + longest, "right")
    q = np.flatnonzero(is_q & (hi > lo))
    n = (hi - lo)[q]
    ends = np.cumsum(n)
    at = 0
    while at < len(q):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        m = n[at:to]
        place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(q[at:to], m), x[np.repeat(lo[q[at:to]], m) + place]
        at = to


def _block(bits: int, percent: int):
    def link(task: pa.Table, group: np.ndarray) -> pa.Table:
        size = np.fromiter(map(len, task["form"].to_pylist()), np.int64, task.num_rows)
        order = np.lexsort((size, group))
        task, group = task.take(pa.array(order)), group[order]
        ids, comp, sims = (task[c].to_numpy() for c in ("id", "component", "sim"))
        is_q, is_x = (task[c].to_numpy(zero_copy_only=False) for c in ("q", "x"))
        forms = task["form"].to_pylist()
        length = size[order]
        band = task["key"].to_numpy() >> 32
        keys = task["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1) if "bands" in task.column_names else None
        a, b = [], []
        label, own = np.unique(comp, return_inverse=True)
        root = np.arange(len(label))  # what these links have made one component, by its least label
        known, threes = np.zeros(len(ids), bool), np.zeros((len(ids), THREE_BINS), np.uint8)
        odd = np.zeros((len(ids), THREE_BINS // 64), np.uint64)
        for q, x in _pairs(group, is_q, is_x, length, percent):
            near = np.flatnonzero(np.bitwise_count((sims[q] ^ sims[x]).view(np.uint64)) <= bits)
            q, x = q[near], x[near]
            near = np.flatnonzero(root[own[q]] != root[own[x]])
            q, x = q[near], x[near]
            # where both are on both sides, one order is enough
            near = np.flatnonzero(~(is_x[q] & is_q[x]) | (ids[q] < ids[x]))
            q, x = q[near], x[near]
            if keys is not None:  # lines that meet in several bands are compared in the first, or were as hub and member
                near = np.concatenate([lo + np.flatnonzero((keys[q[lo : lo + 65536]] == keys[x[lo : lo + 65536]]).argmax(1) == band[q[lo : lo + 65536]]) for lo in range(0, len(q), 65536)] or [near])
                q, x = q[near], x[near]
            allowed = np.maximum(length[q], length[x]) * (100 - percent) // 100
            near = np.flatnonzero(np.abs(length[q] - length[x]) <= allowed)
            for lo in range(0, len(near), 1 << 14):
                part = near[lo : lo + (1 << 14)]
                i, j, most = q[part], x[part], allowed[part]
                new = np.unique(np.concatenate([i, j]))
                new = new[~known[new]]
                threes[new], known[new] = _threes([forms[k] for k in new]), True
                odd[new] = _odd(threes[new])
                good = np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64) <= 6 * most
                i, j, most = i[good], j[good], most[good]
                good = _alike(length[i], threes[i], length[j], threes[j], percent)
                i, j, most = i[good], j[good], most[good]
                for at in range(0, len(i), 2048):  # what is one component by then needs no distance
                    p, r, m = i[at : at + 2048], j[at : at + 2048], most[at : at + 2048]
                    apart = root[own[p]] != root[own[r]]
                    p, r, m = p[apart], r[apart], m[apart]
                    good = within([forms[k] for k in p], [forms[k] for k in r], m)
                    for p, r in zip(p[good].tolist(), r[good].tolist()):
                        u, v = sorted((root[own[p]], root[own[r]]))
                        if u != v and similar(forms[p], forms[r], percent):
                            root[root == v] = u
                            a.append(ids[p])
                            b.append(ids[r])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def repeated_lines(docs: DataFrame, *, bits: int = BITS, blocks: int = BLOCKS, percent: int = PERCENT, least: int = LEAST, every: bool = False, bands: int = 0, letters: int = 0) -> DataFrame:
    """Occurrences to remove: (k, removed array<struct<pos, id>>); k is doc_id, or the least long for a null one."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("k"), "text")
    lines = stash(keyed.mapInArrow(_line_rows(least, every, bands, letters), "k long, pos int, id long, sim long, size int, bands array<int>, form string"))
    spot = F.struct("k", "pos")
    each = stash(lines.groupBy("id").agg(F.min("sim").alias("sim"), F.max("size").alias("size"), F.any_value("bands", F.lit(True)).alias("bands"), F.min(F.struct("k", "pos")).alias("first"), F.count("*").alias("n")))

    if bands:
        key = F.shiftleft(F.col("band").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        buckets = each.select(F.posexplode("bands").alias("band", "value"), "id", "sim", "size").select(key.alias("key"), "id", "sim", "size")
    else:
        size = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
        shift = np.cumsum([0, *size])
        cut = [F.shiftrightunsigned("sim", int(shift[i])).bitwiseAND((1 << size[i]) - 1) for i in range(blocks)]
        keys = []
        for k, chosen in enumerate(combinations(range(blocks), blocks - bits)):
            key = F.lit(k).cast("long")
            for i in chosen:
                key = F.shiftleft(key, size[i]).bitwiseOR(cut[i])
            keys.append(key)
        buckets = each.select(F.explode(F.array(*keys)).alias("key"), "id", "sim", "size")
    # one exchange of the bucket rows; sorted, each bucket is a run whose first row is its hub, whichever line that is; one key of one long sorts by radix
    buckets = buckets.repartition("key").sortWithinPartitions("key")
    met = stash(buckets.mapInArrow(_meetings(bits, percent), "key long, a long, b long, near boolean, more boolean"))

    def texts(wanted: DataFrame, *more: str) -> DataFrame:
        """Normal forms of the wanted lines, and what else their rows hold."""
        return lines.where("form is not null").select("id", "form", *more).join(checked_broadcast(wanted), "id", "left_semi").dropDuplicates(["id"])

    def verify(near: DataFrame) -> DataFrame:
        forms = stash(texts(stash(near.select(F.explode(F.array("a", "b")).alias("id")).distinct())))
        both = near.join(forms.select(F.col("id").alias("a"), F.col("form").alias("fa")), "a").join(forms.select(F.col("id").alias("b"), F.col("form").alias("fb")), "b")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                fa, fb = t["fa"].to_pylist(), t["fb"].to_pylist()
                la, lb = (np.fromiter(map(len, f), np.int64, len(f)) for f in (fa, fb))
                most = np.maximum(la, lb) * (100 - percent) // 100
                good = _alike(la, _threes(fa), lb, _threes(fb), percent)
                left = []  # few changed words prove most pairs of a hub and its copy
                for k in np.flatnonzero(good):
                    if _enough(fa[k], fb[k], int(most[k])) > most[k]:
                        left.append(k)
                good[left] = within([fa[k] for k in left], [fb[k] for k in left], most[left])
                yield pa.record_batch({"a": t["a"], "b": t["b"]}).filter(pa.array(good))

        return both.select("a", "b", "fa", "fb").mapInArrow(check, "a long, b long")

    stars = stash(met.where("near").select("a", "b").distinct())
    rest = met.where("more").select("key", F.col("b").alias("id"))
    parts = link_buckets(stars, rest, lambda wanted: texts(wanted, "sim", *(["bands"] if bands else [])), verify, _block(bits, percent), block_units=BLOCK_LINES)
    # the first occurrence of each group; single lines that occur once need no more work
    owned = each.join(parts, "id", "left").withColumn("g", F.coalesce("component", "id"))
    firsts = owned.groupBy("g").agg(F.min("first").alias("keep"), F.sum("n").alias("all")).where("all > 1")
    extra = stash(owned.join(firsts, "g").select("id", "keep"))
    gone = lines.join(extra, "id").where(spot != F.col("keep")).groupBy("k").agg(F.collect_list(F.struct("pos", "id")).alias("removed"))
    for x in (parts, met, stars, each):
        drop(x)
    return gone


def _rebuild(names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, gone, left = [], [], [], []
            for text, removed in zip(batch["text"], batch["_removed"]):
                text, removed = text.as_py(), removed.as_py()
                parts = (text or "").split("\n")
                at = {}
                for r in removed or ():
                    at.setdefault(r["pos"], set()).add(r["id"])
                kept = [x for pos, x in enumerate(parts) if pos not in at or line_id(normal(x)) not in at[pos]]
                texts.append("\n".join(kept) if at else text)
                lines.append(len(parts) if text else 0)
                gone.append(len(parts) - len(kept))
                left.append(not at or any(normal(x) for x in kept))
            columns = {n: batch[n] for n in names} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(left)], [*columns, "n_lines", "n_removed", "has_own"])

    return rows


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without repeated lines, and n_lines, n_removed, has_own; clashing columns are replaced.

    has_own is false where lines were removed and none of the remaining ones has a letter or digit.  A null text stays null.  Rows that share a
    doc_id are one document: their equal lines at equal places are one occurrence.
    """
    docs = docs.drop("n_lines", "n_removed", "has_own", "_removed", "_k")
    gone = repeated_lines(docs, **options).withColumnsRenamed({"k": "_k", "removed": "_removed"})
    names = docs.columns
    joined = docs.withColumn("_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))).join(gone, "_k", "left").drop("_k")
    extra = [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("has_own", T.BooleanType())]
    return joined.mapInArrow(_rebuild(names), T.StructType([*docs.schema.fields, *extra]))
