"""Main text of HTML pages: block parsing, then a suffix array over each host's token streams.

Pages are parsed into blocks; markup says which are no candidates (menus, forms, adverts, comments ...) and which
stand in the page's main element.  Candidates of a host are concatenated page by page, words as numbers, a unique
number between pages; a suffix array finds substrings of at least ``RUN`` words that ``LEAST_PAGES`` distinct pages of
the host repeat.  Where main elements hold most of a page's candidate text, their blocks are its text, also those
that other pages quote.  Elsewhere the repeated substrings are cut out and the unique runs of each block stay.

A host of more than ``SHARD`` pages is dealt into shards of about so many by a hash of the row, so no host is one
task.  Pages of all shards count, so neither the size of shards nor who is in them matters to the result: shards tell
one another what may be repeated among them, in two steps.  Of each window of ``RUN`` words the least hash of its runs
of ``GRAM`` words comes first, some third of a value a word; only windows whose least hash ``LEAST_PAGES`` pages of
several shards have are then counted themselves.  Those that are on enough pages join the shard's own finds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checked_broadcast
from .text_kernel import _STEP, mix64

RUN, SHARD, LEAST_PAGES, GRAM = 8, 2000, 3, 4
_KIND = lambda names: frozenset(names.split())
#: Fixed values of HTML: element kinds.
RAW = _KIND("script style noscript template textarea title iframe noembed noframes xmp")
VOID = _KIND("area base br col embed hr img input link meta param source track wbr")
BLOCK = _KIND(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr ul"
)
NEVER = RAW | _KIND("head nav aside footer form button select datalist dialog menu svg canvas object audio video map")
MARKED = _KIND(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup social share sharing related recommended recommendations comment comments commentlist disqus respond reply "
    "replies widget toolbar pagination pager login masthead topbar"
)
#: Words that say where or how a marked part stands.
LAYOUT = _KIND(
    "area bar block body bottom box button buttons center column container content desktop fixed form frame global group header heading holder icon icons inner "
    "item items label layout left line link links list main message middle mobile module outer page panel placeholder primary right row secondary section "
    "site slot static sticky tab table tabs text title top unit view wrap wrapper zone"
)
ROLES = _KIND("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|=|[^>=])*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PART = re.compile(r"[^a-z0-9]+")
_CLOSES_P = BLOCK - _KIND("html body li dd dt option td th tr tbody thead tfoot caption legend summary figcaption")


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)}


def _excluded(tag: str, given: dict[str, str], inside: bool) -> bool:
    if tag in NEVER or tag == "header" and not inside:
        return True
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
        return True
    if given.get("role", "").lower() in ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    names = f"{given.get('class', '')} {given.get('id', '')}".lower().split()
    if tag == "article":
        return bool({*names} & {"comment", "comments", "ad", "ads", "advert", "promo"})
    if tag == "p" and inside:
        return False  # a paragraph's class in the main element is about its looks
    return any(_marks(name) for name in names)


def _marks(name: str) -> bool:
    """Whether a class or id names a part that is no main text: a marked word by itself, or one that layout words alone follow.

    "sidebar-left", "ad_slot_3" and "site-footer" do; "ad-hoc-analysis", "comment-on-law" and "popup-culture" do not.
    """
    parts = [x for x in _PART.split(name) if x]
    while parts and parts[-1] not in MARKED and (parts[-1] in LAYOUT or parts[-1].isdigit()):
        parts.pop()
    return bool(parts) and parts[-1] in MARKED


def parse_blocks(page: str) -> list[tuple[str, bool]]:
    """Candidate blocks in page order, each with whether it stands in a main element."""
    out: list[tuple[str, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, excluded, main; each with what it inherits
    places: dict[str, list[int]] = {}  # where each kind of element stands in the stack
    at = 0

    def flush() -> None:
        if text:
            words = " ".join("".join(text).split())
            text.clear()
            if words:
                out.append((words, bool(stack) and stack[-1][2]))

    def pop() -> str:
        tag = stack.pop()[0]
        places[tag].pop()
        return tag

    def close(tag: str) -> None:
        while pop() != tag:
            pass

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    while at < len(page):
        lt = page.find("<", at)
        found = _TAG.match(page, lt) if lt >= 0 else None
        stop = len(page) if lt < 0 else lt if found else lt + 1
        if stop > at and not (stack and stack[-1][1]):
            text.append(unescape(page[at:stop]))
        if not found:
            at = stop
            continue
        at = found.end()
        if not found[2]:
            continue
        end, tag = bool(found[1]), found[2].lower()
        if tag == "br":
            text.append(" ")
            continue
        if end:
            if places.get(tag):
                if tag in BLOCK:
                    flush()
                close(tag)
            continue
        if tag in BLOCK or tag in NEVER:
            flush()
        if tag in _CLOSES_P and last("p") > last("button", "table"):
            close("p")
        elif tag in ("li", "option", "dd", "dt", "tr", "td", "th") and stack and stack[-1][0] == tag:
            pop()
        elif tag == "body" and places.get("head"):
            close("head")
        if tag in VOID:
            continue
        given = _attributes(found[3] or "")
        up = stack[-1] if stack else ("", False, False)
        main = up[2] or tag in ("article", "main") or given.get("role", "").lower() == "main" or given.get("itemprop", "").lower() == "articlebody"
        hide = up[1] or _excluded(tag, given, up[2])
        if tag in RAW:
            ending = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            at = ending.end() if ending else len(page)
            continue
        if not (found[3] or "").rstrip().endswith("/") or tag in BLOCK:
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, hide, main))
    flush()
    return out


def repeated(tokens: np.ndarray, page: np.ndarray, run: int, least: int) -> np.ndarray:
    """Which positions lie in a substring of ``run`` tokens that at least ``least`` distinct pages have.

    A suffix array by prefix doubling, stopped once suffixes are ordered by their first ``run`` tokens: groups of
    equal rank are then the repeated substrings.
    """
    n = len(tokens)
    covered = np.zeros(n + 1, np.int64)
    if n < run:
        return covered[:n] > 0
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        key = rank * (n + 2) + second + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        depth += step
    usable = np.arange(n) + run <= n
    order = np.lexsort((page, rank))
    order = order[usable[order]]
    new = np.ones(len(order), bool)
    same = rank[order][1:] == rank[order][:-1]
    new[1:] = ~(same & (page[order][1:] == page[order][:-1]))
    pages = np.bincount(rank[order], weights=new, minlength=int(rank.max()) + 1)
    often = order[pages[rank[order]] >= least]
    np.add.at(covered, often, 1)
    np.add.at(covered, np.minimum(often + run, n), -1)
    return np.cumsum(covered)[:n] > 0


def _salted(rows: pa.Array) -> pa.Array:
    """Row hashes with the row's place in the batch, so that repeated rows are not all dealt to one shard."""
    with np.errstate(over="ignore"):
        return pa.array((mix64(np.arange(len(rows), dtype=np.uint64)) + rows.to_numpy().view(np.uint64)).view(np.int64))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch["html"]), 200):
            part = batch.slice(lo, 200)
            blocks = [parse_blocks(h.as_py() or "") for h in part["html"]]
            yield pa.RecordBatch.from_arrays(
                [part["page_id"], part["url"], part["host"], _salted(part["row"]), pa.array([[b for b, _ in x] for x in blocks], pa.list_(pa.string())), pa.array([[m for _, m in x] for x in blocks], pa.list_(pa.bool_()))],
                ["page_id", "url", "host", "row", "blocks", "main"],
            )


def _names_main(blocks: list[str], mains: list[bool]) -> bool:
    """Whether main elements hold most of a page's text; a teaser in an article element is not the page's main text."""
    inside = sum(len(b) for b, m in zip(blocks, mains) if m)
    return 0 < inside and 2 * inside >= sum(map(len, blocks))


class _Stream:
    """The pages of a shard as one stream of tokens: words as numbers, a number of its own after each page."""

    def __init__(self, table: pa.Table):
        self.pages = table["blocks"].to_pylist()
        self.ids: dict[str, int] = {}
        ids, tokens, page, block = self.ids, [], [], []
        for p, blocks in enumerate(self.pages):
            for b, words in enumerate(blocks):
                own = [ids.setdefault(w, len(ids)) for w in words.split(" ")]
                tokens += own
                page += [p] * len(own)
                block += [b] * len(own)
            tokens.append(-1 - p)
            page.append(p)
            block.append(len(blocks))
        self.tokens, self.page, self.block = (np.array(x, np.int64) for x in (tokens, page, block))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where windows of ``RUN`` words within a page begin, their hashes, and the least hash of ``GRAM`` words in each, as a 32-bit number."""
        n = len(self.tokens) - RUN + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        known = np.array([int.from_bytes(blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little") for w in self.ids] or [0], np.uint64)
        own = known[np.maximum(self.tokens, 0)]
        runs = lambda k: mix64(sum(own[j : len(own) - k + 1 + j] * _STEP[j] for j in range(k)))
        with np.errstate(over="ignore"):
            whole, grams = runs(RUN), (runs(GRAM) >> np.uint64(32)).astype(np.uint32)
        least = np.lib.stride_tricks.sliding_window_view(grams, RUN - GRAM + 1).min(1)
        inside = np.flatnonzero(self.page[:n] == np.append(self.page, [-1] * RUN)[RUN : n + RUN])
        return inside, whole[inside].view(np.int64), least[inside].view(np.int32)


def _by_slice(key: tuple, shards: int, page: np.ndarray, values: np.ndarray) -> pa.Table:
    """(host, slice, shard, values): each value once for each page that has it, ``LEAST_PAGES`` times at most, dealt by a hash to as many slices as there are shards."""
    order = np.lexsort((page, values))
    v, p = values[order], page[order]
    new = np.append(True, (v[1:] != v[:-1]) | (p[1:] != p[:-1]))[: len(v)]
    v = v[new]
    nth = np.arange(len(v)) - np.searchsorted(v, v)
    v = v[nth < LEAST_PAGES]
    with np.errstate(over="ignore"):
        part = (mix64(v.astype(np.int64).view(np.uint64)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    slices, starts = np.unique(part[order], return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(v)).astype(np.int32)), pa.array(v[order]))
    n = len(slices)
    return pa.table({"host": pa.array([key[0].as_py()] * n, pa.string()), "slice": pa.array(slices), "shard": pa.array([key[1].as_py()] * n, pa.int64()), "found": lists})


def _shards(table: pa.Table) -> int:
    return table["shards"][0].as_py()


def _shard_grams(key: tuple, table: pa.Table) -> pa.Table:
    """What other shards may share: the least hashes of the shard's windows; nothing where the host is one shard."""
    if _shards(table) == 1:
        return _by_slice(key, 1, np.zeros(0, np.int64), np.zeros(0, np.int32))
    stream = _Stream(table)
    at, _, least = stream.windows()
    return _by_slice(key, _shards(table), stream.page[at], least)


def _shard_windows(key: tuple, table: pa.Table, shared: pa.Table) -> pa.Table:
    """The shard's windows whose least hash is shared."""
    if not shared.num_rows:
        return _by_slice(key, 1, np.zeros(0, np.int64), np.zeros(0, np.int64))
    stream = _Stream(table)
    at, whole, least = stream.windows()
    often = np.isin(least, _found(shared))
    return _by_slice(key, _shards(table), stream.page[at][often], whole[often])


def _found(shared: pa.Table) -> np.ndarray:
    return shared["found"].combine_chunks().flatten().to_numpy() if shared.num_rows else np.zeros(0, np.int64)


def _in_several(key: tuple, table: pa.Table) -> pa.Table:
    """A slice's values that ``LEAST_PAGES`` pages of at least two shards have, back to each of these shards."""
    values = _found(table)
    row = np.repeat(np.arange(table.num_rows), table["found"].combine_chunks().value_lengths().to_numpy())
    order = np.lexsort((row, values))
    v, r = values[order], row[order]
    new = np.append(True, v[1:] != v[:-1])[: len(v)]
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(v))[: len(starts)].astype(np.int64)
    several = (ends - starts >= LEAST_PAGES) & (r[starts] != r[ends - 1])
    take = several[group] & np.append(True, (v[1:] != v[:-1]) | (r[1:] != r[:-1]))[: len(v)]
    v, r = v[take], r[take]
    order = np.argsort(r, kind="stable")
    rows = np.unique(r)
    cuts = np.append(np.searchsorted(r[order], rows), len(r)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(v[order]))
    return pa.table({"host": pa.array([key[0].as_py()] * len(rows), pa.string()), "shard": table["shard"].take(pa.array(rows)), "found": lists})


def _shard_text(table: pa.Table, shared: np.ndarray) -> pa.Table:
    """The shard's texts; shared: hashes of windows that other shards' pages make repeated ones."""
    stream, mains = _Stream(table), table["main"].to_pylist()
    pages, page_of, block_of = stream.pages, stream.page, stream.block
    hit = repeated(stream.tokens, page_of, RUN, LEAST_PAGES)
    if len(shared):
        at, whole, _ = stream.windows()
        for start in at[np.isin(whole, shared)]:
            hit[start : start + RUN] = True
    starts = np.searchsorted(page_of, np.arange(len(pages) + 1))
    texts, counts = [], []
    for p, blocks in enumerate(pages):
        own, at = hit[starts[p] : starts[p + 1]], block_of[starts[p] : starts[p + 1]]
        counts.append(int(own.sum()))
        if _names_main(blocks, mains[p]):
            kept = [b for b, m in zip(blocks, mains[p]) if m]
        else:
            cut = np.searchsorted(at, np.arange(len(blocks) + 1))
            kept = [b if not own[i:j].any() else " ".join(w for w, x in zip(b.split(" "), own[i:j]) if not x) for b, i, j in zip(blocks, cut, cut[1:])]
            kept = [b for b in kept if b]
        texts.append("\n".join(kept))
    return pa.table({
        "page_id": table["page_id"], "url": table["url"], "text": pa.array(texts, pa.string()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()), "n_repeated": pa.array(counts, pa.int64()),
    })


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row, and n_repeated: words in substrings that the host repeats.

    A null or empty html has the text "".  A url without a host, or null, counts to the host "".  Repeated rows of one
    page are pages of their own, in the result as in the counts.  Pages of any length and depth are read whole, in time
    linear in their length.  Other columns are not read.
    """
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("host"))
    key = F.xxhash64("page_id", "url", "html")
    sizes = pages.groupBy("host").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    parsed = pages.withColumn("row", key).mapInArrow(_parse, "page_id long, url string, host string, row long, blocks array<string>, main array<boolean>")
    dealt = parsed.join(checked_broadcast(sizes), "host").withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")))
    result = "page_id long, url string, text string, n_chars long, n_repeated long"
    texts = dealt.groupBy("host", "shard")
    if not sizes.where("shards > 1").limit(1).count():
        return texts.applyInArrow(lambda pages: _shard_text(pages, np.zeros(0, np.int64)), result)

    def shared(values: DataFrame, kind: str):
        back = values.groupBy("host", "slice").applyInArrow(_in_several, f"host string, shard long, found array<{kind}>")
        return back.groupBy("host", "shard")

    # every step reads the shards' one exchange again
    grams = shared(texts.applyInArrow(_shard_grams, "host string, slice long, shard long, found array<int>"), "int")
    windows = shared(texts.cogroup(grams).applyInArrow(_shard_windows, "host string, slice long, shard long, found array<long>"), "long")
    return texts.cogroup(windows).applyInArrow(lambda pages, found: _shard_text(pages, _found(found)), result)
