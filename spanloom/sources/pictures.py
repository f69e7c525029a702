"""Pictures and frame sequences: decoding, archives, sampling and preparation in Arrow batches.

Formats decoded without further libraries: PNG (8 bits, not interlaced), PNM (P5, P6) and YUV4MPEG2 frames.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import PRESETS, archive_member, archive_path

#: Bytes that one decoded picture may have.
MOST_BYTES = 1 << 30
PNM_HEAD = re.compile(rb"(P[56])(?:\s|#[^\n]*\n)+(\d{1,9})(?:\s|#[^\n]*\n)+(\d{1,9})(?:\s|#[^\n]*\n)+\d{1,3}\s")
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # fixed values of the format: colour type to samples a pixel


def _png(data: bytes) -> np.ndarray:
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk[: len(chunk) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + n
    if head is None or head[2] != 8 or head[6] or head[3] not in PNG_CHANNELS:
        raise ValueError("only 8-bit PNG without interlacing")
    width, height, k = head[0], head[1], PNG_CHANNELS[head[3]]
    size = height * (1 + width * k)
    if not 0 < size <= MOST_BYTES:
        raise ValueError(f"a PNG of {width} x {height} pixels")
    raw = zlib.decompressobj().decompress(body, size)
    if len(raw) < size:
        raise ValueError("the picture's data end early")
    rows = np.frombuffer(raw, np.uint8).reshape(height, 1 + width * k)
    picture = _unfilter(rows[:, 0], rows[:, 1:].reshape(height, width, k))
    if head[3] != 3:
        return picture
    if palette is None or int(picture.max()) >= len(palette):
        raise ValueError("a colour index without a palette entry")
    return palette[picture[..., 0]]


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Pixels of filtered rows, one diagonal (of constant row + column) after the other, each in one step.

    A pixel's neighbours to the left, above and between lie on the two diagonals before.
    """
    height, width, k = rows.shape
    out = np.zeros((height + 1, width + 1, k), np.int16)
    if not np.isin(kinds, (3, 4)).any():  # no filter mixes directions: whole rows at once
        for y, kind in enumerate(kinds):
            row = rows[y].astype(np.int64)
            out[y + 1, 1:] = (np.cumsum(row, 0) if kind == 1 else row + out[y, 1:] if kind == 2 else row) & 255
        return out[1:, 1:].astype(np.uint8)
    for t in range(height + width - 1):
        y = np.arange(max(0, t - width + 1), min(height, t + 1))
        x = t - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        da, db, dc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        kind = kinds[y][:, None]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [a, b, (a + b) // 2, nearest], 0)
        out[y + 1, x + 1] = (rows[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _pnm(data: bytes) -> np.ndarray:
    found = PNM_HEAD.match(data)
    if not found:
        raise ValueError("not the beginning of an 8-bit PNM picture")
    width, height, k = int(found[2]), int(found[3]), 3 if found[1] == b"P6" else 1
    if not 0 < width * height * k <= len(data) - found.end():
        raise ValueError("the picture's data end early")
    return np.frombuffer(data, np.uint8, width * height * k, found.end()).reshape(height, width, k)


def decode(data: bytes) -> np.ndarray:
    """O-1, O-30: height x width x 3 bytes."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        picture = _png(data)
    elif data[:2] in (b"P5", b"P6"):
        picture = _pnm(data)
    else:
        raise ValueError("unknown picture format")
    k = picture.shape[2]
    if k == 2:
        raise ValueError("two channels are no picture")
    return np.repeat(picture, 3, 2) if k == 1 else picture[..., :3]


def _cubic(n: int, size: int) -> np.ndarray:
    """The size x n matrix of bicubic resampling, widened when shrinking so that no pixel is skipped."""
    scale = n / size
    wide = max(scale, 1.0)
    centre = (np.arange(size) + 0.5) * scale - 0.5
    x = np.abs(centre[:, None] - np.arange(n)[None, :]) / wide
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))
    return w / w.sum(1, keepdims=True)


def resize(picture: np.ndarray, size: int) -> np.ndarray:
    """O-31: bicubic to size x size, as numbers in the range of the input."""
    h, w = picture.shape[:2]
    return np.clip(np.einsum("ih,hwc,jw->ijc", _cubic(h, size), picture.astype(np.float64), _cubic(w, size), optimize=True), 0, 255)


def prepare(picture: np.ndarray, size: int, preset: int, stereo: bool = False) -> np.ndarray:
    """O-28, O-32 to O-36: channels first, normalised; half of a stereo picture."""
    if stereo:
        h, w = picture.shape[:2]
        picture = picture[:, w // 2 :] if w / h > 1.5 else picture[: h // 2, w // 4 : 3 * w // 4]
    mean, deviation = map(np.array, PRESETS[preset])
    tensor = ((resize(picture, size) / 255.0 - mean) / deviation).transpose(2, 0, 1)
    if tensor.shape != (3, size, size):
        raise ValueError(f"shape {tensor.shape} is not (3, {size}, {size})")
    return tensor.astype(np.float32)


def picture_bytes(requests: DataFrame, files: DataFrame) -> DataFrame:
    """O-2 to O-4: requests(path) with their bytes, from files(path, content); also members of zip archives.

    What cannot be found has null content and an error.
    """
    wanted = requests.select("path", archive_path(F.col("path")).alias("archive"), archive_member(F.col("path")).alias("member"))
    wanted = wanted.withColumn("file", F.coalesce("archive", "path"))
    found = wanted.join(files.withColumnsRenamed({"path": "file"}), "file", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents, errors = [], []
            for archive, member, content in zip(b["archive"].to_pylist(), b["member"].to_pylist(), b["content"]):
                data, error = content.as_py(), None
                if data is None:
                    error = "not found"
                elif archive is not None:
                    try:
                        if not member:
                            raise KeyError("no member named")
                        with zipfile.ZipFile(io.BytesIO(data)) as z:
                            data = z.read(member)
                    except (KeyError, zipfile.BadZipFile) as e:
                        data, error = None, str(e)
                contents.append(data)
                errors.append(error)
            yield pa.record_batch({"path": b["path"], "content": pa.array(contents, pa.binary()), "error": pa.array(errors, pa.string())})

    return found.select("path", "archive", "member", "content").mapInArrow(extract, "path string, content binary, error string")


def prepared_pictures(pictures: DataFrame, size: int, preset: int) -> DataFrame:
    """O-35: (path, content, error) to (path, tensor, error); a failing picture has a null tensor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, error in zip(b["path"].to_pylist(), b["content"], b["error"].to_pylist()):
                tensor = None
                if content.is_valid:
                    try:
                        tensor = prepare(decode(content.as_py()), size, preset).ravel()
                    except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error) as e:
                        error = str(e) or type(e).__name__
                yield pa.record_batch({"path": pa.array([path]), "tensor": pa.array([tensor], pa.list_(pa.float32())), "error": pa.array([error], pa.string())})

    return pictures.mapInArrow(run, "path string, tensor array<float>, error string")


def _y4m(data: memoryview) -> tuple[int, int, Fraction, int, int, int]:
    """Width, height, rate, bytes of a frame, position of the first, bytes before each frame's pixels."""
    end = bytes(data[:4096]).find(b"\n")
    fields = bytes(data[: max(end, 0)]).split(b" ")
    if fields[0] != b"YUV4MPEG2":
        raise ValueError("not a YUV4MPEG2 stream")
    values = {f[:1]: f[1:].decode() for f in fields[1:]}
    w, h = int(values[b"W"]), int(values[b"H"])
    kind, rate = values.get(b"C", "420"), Fraction(values.get(b"F", "30:1").replace(":", "/"))
    if w < 1 or h < 1 or rate <= 0:
        raise ValueError(f"a stream of {w} x {h} pixels at {rate} frames a second")
    size = w * h if kind == "mono" else w * h * 3 if kind.startswith("444") else w * h * 2 if kind.startswith("422") else w * h + 2 * ((w + 1) // 2) * ((h + 1) // 2)
    return w, h, rate, size, end + 1, len(b"FRAME\n")


def _header(content) -> tuple[tuple | None, memoryview, str | None]:
    """A stream's header, its bytes, and what is wrong with it."""
    data = memoryview(content.as_buffer()) if content.is_valid else memoryview(b"")
    try:
        return _y4m(data), data, None
    except (ValueError, KeyError, ZeroDivisionError, UnicodeDecodeError) as e:
        return None, data, str(e) or type(e).__name__


def frame_scan(files: DataFrame, interval: float, timestamps: bool = True) -> DataFrame:
    """O-10, O-11, O-22 to O-25: sampled frames of media files(path, content): (path, n, frame_index, width, height, luma, error).

    Only every step-th frame's bytes are touched.  frame_index is ordinal * interval (ledger Q17), or n without
    timestamps; with an interval not above 0 all frames come, at n / rate.  A file that cannot be read is one row
    with its error (O-110) and fails nothing else.
    """
    kinds = {"path": pa.string(), "n": pa.int64(), "frame_index": pa.float64(), "width": pa.int32(), "height": pa.int32(), "luma": pa.binary(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            out = pa.record_batch({c: pa.array(v, kinds[c]) for c, v in zip(kinds, zip(*rows))})
            rows.clear()
            return out

        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"]):
                head, data, error = _header(content)
                if head is None:
                    rows.append((path, None, None, None, None, None, error))
                    continue
                w, h, rate, size, first, skip = head
                step = max(1, round(float(rate) * interval)) if interval > 0 else 1
                total = (len(data) - first) // (size + skip)
                for k, n in enumerate(range(0, total, step)):
                    at = first + n * (size + skip) + skip
                    index = float(n) if not timestamps else k * interval if interval > 0 else float(n / rate)
                    rows.append((path, n, index, w, h, bytes(data[at : at + w * h]), None))
                    held += w * h
                    if held >= 8 << 20:  # some frames a batch, whatever their size
                        yield flush()
                        held = 0
        if rows:
            yield flush()

    return files.select("path", "content").mapInArrow(run, "path string, n long, frame_index double, width int, height int, luma binary, error string")


def scan_tensors(frames: DataFrame, size: int, preset: int) -> DataFrame:
    """O-36: rows of ``frame_scan`` to (path, n, frame_index, tensor, error), grey pictures as three equal channels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 16):
                part = b.slice(lo, 16)
                tensors = []
                for luma, w, h in zip(part["luma"], part["width"].to_pylist(), part["height"].to_pylist()):
                    grey = np.frombuffer(luma.as_buffer(), np.uint8).reshape(h, w, 1) if luma.is_valid else None
                    tensors.append(None if grey is None else prepare(np.repeat(grey, 3, 2), size, preset).ravel())
                yield pa.record_batch({"path": part["path"], "n": part["n"], "frame_index": part["frame_index"], "tensor": pa.array(tensors, pa.list_(pa.float32())), "error": part["error"]})

    return frames.select("path", "n", "frame_index", "width", "height", "luma", "error").mapInArrow(run, "path string, n long, frame_index double, tensor array<float>, error string")


def media_probe(files: DataFrame) -> DataFrame:
    """O-7: width, height, rate and duration from each file's header, or its error (O-110)."""
    kinds = {"path": pa.string(), "width": pa.int32(), "height": pa.int32(), "fps": pa.float64(), "n_frames": pa.int64(), "duration": pa.float64(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"].to_pylist(), b["content"]):
                head, data, error = _header(content)
                if head is None:
                    rows.append((path, None, None, None, None, None, error))
                    continue
                w, h, rate, size, first, skip = head
                n = (len(data) - first) // (size + skip)
                rows.append((path, w, h, float(rate), n, float(n / rate), None))
            if rows:
                yield pa.record_batch({c: pa.array(v, kinds[c]) for c, v in zip(kinds, zip(*rows))})

    return files.select("path", "content").mapInArrow(run, "path string, width int, height int, fps double, n_frames long, duration double, error string")
