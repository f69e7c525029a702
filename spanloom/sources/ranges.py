"""O-4, O-10, O-11: large files read by ranges: frames of uncompressed streams and members of zip archives as data sources.

A file is cut into byte ranges by its size alone, so the driver lists files and opens none.  A task reads the header, or
the archive's directory from its tail, and then what begins in its range: one file may be many tasks, and only the bytes of what is
asked for are read.  Paths are local ones or URIs of any store that pyarrow's file systems reach.

    spark.dataSource.register(FrameSource)
    spark.read.format("frames").option("interval", 2.0).load("file:///media").where("frame_index >= 60")
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .pictures import _y4m

#: Bytes of a file in one task, frames or members in one Arrow batch by their bytes.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 8 << 20


@dataclass
class Range(InputPartition):
    """What begins at ``start`` or later and before ``end`` in a file."""

    uri: str
    start: int
    end: int


def _system(uri: str) -> tuple[fs.FileSystem, str, str]:
    """A path's file system, the path there, and what to put before such paths to have the caller's form again."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri, ""
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, uri[: len(uri) - len(path)] if uri.endswith(path) else "file://"


def _open(uri: str):
    system, path, _ = _system(uri)
    return system.open_input_file(path)


class _RangeReader(DataSourceReader):
    """Lists files, prunes them by pushed filters on ``path_column``, and cuts them into ranges."""

    path_column, suffix = "path", ""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[-1] if hasattr(f, "attribute") else None
            if column == self.path_column and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = wanted if self.paths is None else self.paths & wanted
            elif not self.push(column, f):
                yield f

    def push(self, column: str | None, f: Filter) -> bool:
        return False

    def partitions(self) -> list[Range]:
        system, path, before = _system(self.root)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = [f for f in files if f.type == fs.FileType.File and (f is info or f.path.endswith(self.suffix))]
        named = [(before + f.path, f.size) for f in sorted(files, key=lambda f: f.path)]
        out = [Range(uri, at, at + self.range_bytes) for uri, size in named if self.paths is None or uri in self.paths for at in range(0, max(size, 1), self.range_bytes)]
        return out or [Range("", 0, 0)]  # a source of no files still has a partition

    def _batches(self, rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for r in rows:
            held.append(r)
            size += max((len(c) for c in r if isinstance(c, bytes)), default=0) + 100
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.uri:
            yield from self._batches(self.rows(partition), self.arrow)


class _FrameReader(_RangeReader):
    suffix = ".y4m"
    arrow = pa.schema([("path", pa.string()), ("n", pa.int64()), ("frame_index", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("luma", pa.binary()), ("error", pa.string())])

    def __init__(self, options: dict):
        super().__init__(options)
        self.interval = float(options.get("interval", 0))
        self.bounds: list[tuple[str, type, float]] = []

    def push(self, column, f) -> bool:
        if column in ("n", "frame_index") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
            self.bounds.append((column, type(f), f.value))
            return True
        return False

    def _wanted(self, n: int, index: float) -> bool:
        for column, kind, value in self.bounds:
            x = n if column == "n" else index
            if not {EqualTo: x == value, GreaterThan: x > value, GreaterThanOrEqual: x >= value, LessThan: x < value, LessThanOrEqual: x <= value}[kind]:
                return False
        return True

    def rows(self, part: Range) -> Iterator[tuple]:
        bad = lambda e: (part.uri, None, None, None, None, None, str(e) or type(e).__name__)
        with _open(part.uri) as f:
            try:
                w, h, rate, size, first, skip = _y4m(memoryview(f.read_at(4096, 0)))
            except (ValueError, KeyError, ZeroDivisionError, UnicodeDecodeError) as e:
                if part.start == 0 and not self.bounds:  # one row a file; a bound on frames leaves it out
                    yield bad(e)
                return
            step = max(1, round(float(rate) * self.interval)) if self.interval > 0 else 1
            each, total = size + skip, (f.size() - first) // (size + skip)
            begin = max(0, -(-(part.start - first) // each))
            for n in range(-(-begin // step) * step, min(total, -(-(part.end - first) // each)), step):
                index = n // step * self.interval if self.interval > 0 else float(Fraction(n) / rate)
                if not self._wanted(n, index):
                    continue
                data = f.read_at(skip + w * h, first + n * each)
                if data[:skip] != b"FRAME\n":
                    yield bad(ValueError(f"frame {n} has parameters of its own or is damaged"))
                    return
                yield part.uri, n, index, w, h, data[skip:], None


class FrameSource(DataSource):
    """``frames``: (path, n, frame_index, width, height, luma, error) of all .y4m files under a path, or of one file.

    Options: interval, seconds between frames (0, the default: every frame); rangeBytes, bytes of a file in a task.  frame_index is
    the ordinal of the sampled frame times the interval, or n / rate without one.  Filters on path, n and frame_index
    are pushed down: files and frames outside are not read.  A file whose header can't be read is one row with its error; a
    damaged frame is one, and ends its range.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "path string, n long, frame_index double, width int, height int, luma binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(self.options)


class _Seekable(io.RawIOBase):
    """A file of a store as zipfile takes it: a seek to before the beginning is an OSError there."""

    def __init__(self, f):
        self.f = f

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        return self.f.readinto(buffer)

    def tell(self) -> int:
        return self.f.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.f.seek(offset, whence)
        except ValueError as e:
            raise OSError(str(e)) from e


class _MemberReader(_RangeReader):
    path_column, suffix = "archive", ".zip"
    arrow = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])

    def __init__(self, options: dict):
        super().__init__(options)
        self.members: set[str] | None = None
        self.content = str(options.get("content", "true")).lower() != "false"

    def push(self, column, f) -> bool:
        if column == "member" and isinstance(f, (EqualTo, In)):
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.members = wanted if self.members is None else self.members & wanted
            return True
        return False

    def rows(self, part: Range) -> Iterator[tuple]:
        with _open(part.uri) as f:
            try:
                archive = zipfile.ZipFile(io.BufferedReader(_Seekable(f)))
            except (zipfile.BadZipFile, OSError, ValueError) as e:
                if part.start == 0 and self.members is None:
                    yield part.uri, None, None, None, str(e) or type(e).__name__
                return
            with archive:
                for m in archive.infolist():
                    if m.is_dir() or not part.start <= m.header_offset < part.end or self.members is not None and m.filename not in self.members:
                        continue
                    data, error = None, None
                    if self.content:
                        try:
                            data = archive.read(m)
                        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, EOFError, ValueError) as e:
                            error = str(e) or type(e).__name__
                        except Exception as e:  # noqa: BLE001  a decompressor's own error class
                            error = f"{type(e).__name__}: {e}"
                    yield part.uri, m.filename, m.file_size, data, error


class MemberSource(DataSource):
    """``zip_members``: (archive, member, size, content, error) of all .zip files under a path, or of one archive.

    Options: content, "false" to list only; rangeBytes, bytes of an archive in a task.  Filters on archive and member are pushed
    down.  An archive is opened once a range, members of it are read by their places; what cannot be read is a row with
    its error, and fails nothing else.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, size long, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _MemberReader(self.options)


def register(spark) -> None:
    """Both sources, with their filters pushed down, for a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
    spark.dataSource.register(MemberSource)
