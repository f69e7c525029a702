"""Media columns: ISO base media containers, written, walked and indexed without decoding payloads.

``pack`` stores a byte payload as one video track of raw 8-bit samples: frames of ``SIDE * SIDE`` grey bytes,
``PER_CHUNK`` frames a chunk, a sync sample every ``KEY_EVERY`` frames.  ``probe`` walks the nested boxes of any
container of the family (32- and 64-bit sizes, boxes to the end of file, unknown boxes skipped), decodes the
sample tables and gives codec, duration and the byte range of every keyframe.  A malformed container has null
codec and an ``error`` text rather than failing the task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE, PER_CHUNK, KEY_EVERY, RATE = 8, 16, 32, 25
FRAME = SIDE * SIDE
#: Fixed values of the container format: boxes that hold only boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf")
#: Fixed value of the container format: the unity transformation matrix of movie and track headers.
UNITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _words(values) -> bytes:
    return np.asarray(values, ">u4").tobytes()


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of the frame size."""
    return data + b"\0" * (-len(data) % FRAME if data else FRAME)


def pack(payload: bytes) -> bytes:
    """A container whose samples are the payload, whose length is a positive multiple of ``FRAME``."""
    n = len(payload) // FRAME
    chunks = -(-n // PER_CHUNK)
    last = n - (chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK, 1)] if last == PER_CHUNK or chunks > 1 else []
    if last != PER_CHUNK:
        runs.append((chunks, last, 1))
    wide = len(payload) > 0xF0000000
    offsets = np.arange(chunks, dtype=np.int64) * (PER_CHUNK * FRAME)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = _box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1),
        bytes(32), struct.pack(">Hh", 8, -1),
    )

    def movie(base: int) -> bytes:
        at = offsets + base
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", -(-n // KEY_EVERY)), _words(np.arange(1, n + 1, KEY_EVERY))),
            _full(b"stsc", struct.pack(">I", len(runs)), _words(runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64", struct.pack(">I", chunks), at.astype(">u8").tobytes()) if wide else _full(b"stco", struct.pack(">I", chunks), _words(at)),
        )
        url = _full(b"url ", flags=1)
        return _box(
            b"moov",
            _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), UNITY, bytes(24), struct.pack(">I", 2)),
            _box(
                b"trak",
                _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), UNITY, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7),
                _box(
                    b"mdia",
                    _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)),
                    _full(b"hdlr", bytes(4), b"vide", bytes(12), b"text\0"),
                    _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), url)), stbl),
                ),
            ),
        )

    size = len(payload) + 8
    mdat = struct.pack(">I4s", size, b"mdat") if size < 1 << 32 else struct.pack(">I4sQ", 1, b"mdat", size + 8)
    return b"".join((head, movie(len(head) + len(movie(0)) + len(mdat)), mdat, payload))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first and last position of the body) of each box between two positions."""
    while end - start >= 8:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has {size} bytes, {end - start} remain")
        yield kind, start + head, start + size
        start += size


def _tables(data: memoryview) -> tuple[list[dict], list[dict], dict]:
    """Tracks and track fragments, each with its leaf boxes, and the defaults of later fragments by track number.

    The nesting is walked with an own stack, so its depth is bounded by the file alone.
    """
    tracks, parts, defaults = [], [], {}
    todo: list[tuple[int, int, dict, int]] = [(0, len(data), {}, 0)]
    while todo:
        start, end, found, moof = todo.pop()
        inner = []
        for kind, lo, hi in boxes(data, start, end):
            if kind in (b"trak", b"traf"):
                own = {"moof": moof}
                (tracks if kind == b"trak" else parts).append(own)
                inner.append((lo, hi, own, moof))
            elif kind in CONTAINERS:
                inner.append((lo, hi, found, lo - 8 if kind == b"moof" else moof))
            elif kind == b"trex":
                track, _, duration, size, flags = struct.unpack_from(">5I", data, lo + 4)
                defaults[track] = (duration, size, flags)
            elif kind == b"trun":
                found.setdefault("runs", []).append((lo, hi))
            else:
                found[kind] = (lo, hi)
        todo += reversed(inner)
    return tracks, parts, defaults


def _column(data: memoryview, at: int, n: int, kind: str = ">u4", end: int | None = None) -> np.ndarray:
    """``n`` numbers of a table; ValueError where the box, or the file, is too short for so many."""
    if at + n * np.dtype(kind).itemsize > (len(data) if end is None else end):
        raise ValueError(f"a table of {n} entries at {at} goes beyond its box")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def _table(data: memoryview, box: tuple[int, int], width: int = 1, kind: str = ">u4") -> np.ndarray:
    """A full box's table of counted entries, each of ``width`` numbers."""
    return _column(data, box[0] + 8, width * struct.unpack_from(">I", data, box[0] + 4)[0], kind, box[1])


class _Claims:
    """Samples of a size that is stated once, over all tracks and runs: together they can't be more than the file.

    Sizes that are listed one by one are bounded by their tables' own bytes.
    """

    def __init__(self, data: memoryview):
        self.left = len(data)

    def take(self, n: int, size: int) -> None:
        self.left -= n * max(size, 1)
        if self.left < 0:
            raise ValueError(f"{n} samples of {size} bytes, and those before, are more than the file")


def _stored_samples(data: memoryview, t: dict, claims: _Claims) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Offsets, sizes, keyframes and chunk ranges by a track's sample tables."""
    if b"stsz" not in t:
        raise ValueError("no table of sample sizes")
    fixed, n = struct.unpack_from(">II", data, t[b"stsz"][0] + 4)
    if fixed:
        claims.take(n, fixed)
    sizes = np.full(n, fixed, np.int64) if fixed else _column(data, t[b"stsz"][0] + 12, n, end=t[b"stsz"][1])
    chunk = _table(data, t[b"co64"], kind=">u8") if b"co64" in t else _table(data, t[b"stco"])
    runs = _table(data, t[b"stsc"], 3).reshape(-1, 3)
    steps = np.diff(np.append(runs[:, 0], len(chunk) + 1))
    if (steps < 0).any() or int(steps.sum()) != len(chunk) or int((runs[:, 1] * steps).sum()) != n:
        raise ValueError("sample tables disagree")
    per = np.repeat(runs[:, 1], steps)
    # a sample starts at its chunk's offset plus the sizes before it in that chunk
    before = np.concatenate([[0], np.cumsum(sizes)])
    first = np.cumsum(per) - per
    owner = np.repeat(np.arange(len(chunk)), per)
    offsets = chunk[owner] + before[:-1] - before[first[owner]]
    keys = _table(data, t[b"stss"]) - 1 if b"stss" in t else np.arange(n)
    if len(keys) and not 0 <= int(keys.min()) <= int(keys.max()) < n:
        raise ValueError("a sync sample is none of the samples")
    ends = chunk + before[first + per] - before[first]
    return offsets, sizes, keys, list(zip(chunk.tolist(), ends.tolist()))


def _fragment_samples(data: memoryview, part: dict, defaults: dict, claims: _Claims) -> tuple[int, list, list, list, list, int]:
    """Track number, arrays of offsets, sizes and sync marks by run, the runs' byte ranges, and the duration of a track fragment."""
    at = part[b"tfhd"][0]
    flags, track = struct.unpack_from(">II", data, at)
    flags, at = flags & 0xFFFFFF, at + 8
    base, duration, size, mark = part["moof"], *defaults.get(track, (0, 0, 0))
    if flags & 1:
        base, at = struct.unpack_from(">Q", data, at)[0], at + 8
    at += 4 if flags & 2 else 0
    fields = [8, 16, 32]
    values = [duration, size, mark]
    for k, bit in enumerate(fields):
        if flags & bit:
            values[k], at = struct.unpack_from(">I", data, at)[0], at + 4
    duration, size, mark = values
    offsets, sizes, syncs, ranges, total = [], [], [], [], 0
    place = base
    for lo, hi in part.get("runs", ()):
        own, n = struct.unpack_from(">II", data, lo)
        own, at, first = own & 0xFFFFFF, lo + 8, None
        if own & 1:
            place, at = base + struct.unpack_from(">i", data, at)[0], at + 4
        if own & 4:
            first, at = struct.unpack_from(">I", data, at)[0], at + 4
        columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if own & bit]
        if not columns:
            claims.take(n, size)
        table = _column(data, at, n * len(columns), end=hi).reshape(n, len(columns))
        of = {bit: table[:, k] for k, bit in enumerate(columns)}
        each = of.get(0x200, np.full(n, size, np.int64))
        marks = of.get(0x400, np.full(n, mark, np.int64)).copy()
        if first is not None and n:
            marks[0] = first
        total += int(of[0x100].sum()) if 0x100 in of else n * duration
        if n:
            offsets.append(place + np.cumsum(each) - each)
            sizes.append(each)
            syncs.append(marks & 0x10000 == 0)
            ranges.append((place, place + int(each.sum())))
        place += int(each.sum())
    return track, offsets, sizes, syncs, ranges, total


def probe_tracks(container: bytes) -> list[dict]:
    """Of every track: number, kind, codec, timescale, duration, its samples' offsets and sizes, keyframe positions.

    Samples are those of the sample tables, then those of movie fragments; a run of samples is one chunk.  What samples take in memory
    is bounded by the container's own size, whatever its tables claim.
    """
    data = memoryview(container)
    tracks, parts, defaults = _tables(data)
    if not tracks:
        raise ValueError("no track")
    out, claims = [], _Claims(data)
    for t in tracks:
        at = t[b"mdhd"][0]
        scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        codec = bytes(data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16]).decode("latin-1")
        number = struct.unpack_from(">I", data, t[b"tkhd"][0] + (20 if data[t[b"tkhd"][0]] == 1 else 12))[0] if b"tkhd" in t else 0
        kind = bytes(data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]).decode("latin-1") if b"hdlr" in t else ""
        offsets, sizes, keys, chunks = _stored_samples(data, t, claims)
        out.append({"track": number, "kind": kind, "codec": codec, "timescale": scale, "duration": duration, "offsets": offsets, "sizes": sizes, "keys": keys, "chunks": chunks})
    by = {t["track"]: t for t in out}
    more: dict[int, tuple[list, list, list]] = {number: ([], [], []) for number in by}
    for part in parts:
        track, offsets, sizes, syncs, ranges, duration = _fragment_samples(data, part, defaults, claims)
        if track not in by:
            raise ValueError(f"a fragment of track {track}, which there is not")
        for held, new in zip(more[track], (offsets, sizes, syncs)):
            held += new
        by[track]["chunks"] += ranges
        by[track]["duration"] += duration
    for number, (offsets, sizes, syncs) in more.items():
        if sizes:
            t, n = by[number], len(by[number]["sizes"])
            t["keys"] = np.concatenate([t["keys"], n + np.flatnonzero(np.concatenate(syncs))])
            t["offsets"], t["sizes"] = np.concatenate([t["offsets"], *offsets]), np.concatenate([t["sizes"], *sizes])
    return out


def probe(container: bytes) -> dict:
    """``probe_tracks`` of the first video track, or of the first one where none is video."""
    tracks = probe_tracks(container)
    return next((t for t in tracks if t["kind"] == "vide"), tracks[0])


_RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
_TRACK = pa.struct([("kind", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", _RANGES)])
INDEX = (
    "codec string, timescale long, duration long, n_samples long, keyframes array<struct<offset: long, size: long>>, "
    "tracks array<struct<kind: string, codec: string, timescale: long, duration: long, n_samples: long, keyframes: array<struct<offset: long, size: long>>>>, error string"
)


def _track_row(t: dict) -> dict:
    ranges = [{"offset": int(o), "size": int(s)} for o, s in zip(t["offsets"][t["keys"]], t["sizes"][t["keys"]])]
    return {n: t[n] for n in ("kind", "codec", "timescale", "duration")} | {"n_samples": len(t["sizes"]), "keyframes": ranges}


def _index_row(container: bytes | None) -> dict:
    names = ("codec", "timescale", "duration", "n_samples", "keyframes")
    try:
        tracks = [_track_row(t) for t in probe_tracks(container or b"")]
        main = next((t for t in tracks if t["kind"] == "vide"), tracks[0])
        return {n: main[n] for n in names} | {"tracks": tracks, "error": None}
    except (ValueError, KeyError, IndexError, OverflowError, struct.error) as e:
        return dict.fromkeys((*names, "tracks")) | {"error": str(e) or type(e).__name__}


def media_columns(frames: DataFrame, column: str = "media") -> DataFrame:
    """``frames`` with the container's index as further columns (prefix ``media_``); the payload stays untouched.

    The columns are those of the first video track (or first track); ``media_tracks`` has all tracks.  A null, empty
    or malformed container has only ``media_error``.
    """
    kind = pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", _RANGES), ("tracks", pa.list_(_TRACK)), ("error", pa.string())])

    @F.arrow_udf(f"struct<{INDEX}>")
    def index(values: pa.Array) -> pa.Array:
        return pa.array([_index_row(v) for v in values.to_pylist()], kind)

    names = [f.name for f in kind]
    out = frames.withColumn("_index", index(F.col(column)))
    return out.select(*frames.columns, *(F.col(f"_index.{n}").alias(f"media_{n}") for n in names))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "n_samples", "keyframes")
    for batch in batches:
        ids, texts = batch["doc_id"], batch["text"].cast(pa.large_binary())
        for lo in range(0, len(ids), 64):
            rows: dict[str, list] = {n: [] for n in names}
            for value in texts.slice(lo, 64):
                data = value.as_py() or b""
                media = pack(padded(data))
                p = probe(media)
                seen, tail, total = sha256(), b"", 0
                for a, b in p["chunks"]:
                    seen.update(memoryview(media)[a:b])
                    tail, total = (tail + media[a:b])[-FRAME:], total + b - a
                at, size = p["offsets"][p["keys"]], p["sizes"][p["keys"]]
                ranges = sha256(np.column_stack([at, size]).astype(">i8").tobytes()).hexdigest()[:16]
                feature = f"{p['codec'].strip()}/{p['timescale']}/{p['duration']}/{len(p['sizes'])}/{len(at)}/{at[0]}-{at[-1] + size[-1]}/{ranges}"
                keys = [{"offset": int(o), "size": int(s)} for o, s in zip(at, size)]
                for n, v in zip(names, (len(data), total, seen.hexdigest(), zlib.crc32(tail), len(media), sha256(media).hexdigest(), feature, p["codec"], p["duration"] / p["timescale"], len(p["sizes"]), keys)):
                    rows[n].append(v)
            kinds = dict(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), _RANGES)))
            yield pa.record_batch({"doc_id": ids.slice(lo, 64)} | {n: pa.array(v, kinds[n]) for n, v in rows.items()})


def media_digests(docs: DataFrame) -> DataFrame:
    """Each text stored as a container, read back through its sample tables, with digests and index columns.

    A null text counts as empty and is one frame of zero bytes; a text of any length is one container, so a task
    holds a few times its longest text.  Repeated rows are repeated in the result; other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _digests,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "feature string, codec string, duration_s double, n_samples long, keyframes array<struct<offset: long, size: long>>",
    )
