"""Capture tags of JPEG headers by ranged reads: a Python data source that plans files and reads only what leads to their tags."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from scene_qa.sources.listing import matched, opened

#: Bytes of a read, unless an Exif block of up to 64 KiB is wanted; files of a task.
BLOCK, FILES = 4096, 256
SCHEMA = "path string, taken string, changed string, camera string, bytes_read long"


class Ranges:
    """A file read by ranges: the last range is held, and served from while it lasts."""

    def __init__(self, file: pa.NativeFile | BytesIO, block: int = BLOCK):
        self.file, self.block, self.start, self.held, self.taken = file, block, 0, b"", 0

    def bytes(self, at: int, n: int) -> bytes:
        """n bytes from `at`, fewer at the end of the file."""
        if not self.start <= at <= at + n <= self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(n, self.block))
            self.taken += len(self.held)
        return self.held[at - self.start : at - self.start + n]


def exif_block(ranges: Ranges) -> bytes | None:
    """The Exif block of a JPEG, null if it has none: its segments are walked by their lengths to the picture itself, wherever
    the block stands, over any number of segments and fill bytes."""
    if ranges.bytes(0, 2) != b"\xff\xd8":
        return None
    at = 2
    while len(head := ranges.bytes(at, 2)) == 2 and head[0] == 0xFF:  # each turn moves on
        kind = head[1]
        if kind == 0xFF:
            run = ranges.bytes(at, 256) or head
            at += max(1, len(run) - len(run.lstrip(b"\xff")) - 1)
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # stands alone
            at += 2
        elif kind in (0xD9, 0xDA) or (size := int.from_bytes(ranges.bytes(at + 2, 2), "big")) < 2:
            return None
        elif kind == 0xE1 and ranges.bytes(at + 4, 6) == b"Exif\0\0":
            return ranges.bytes(at + 4, size - 2)
        else:
            at += 2 + size
    return None


def header_tags(data: bytes) -> tuple[str | None, str | None, str | None]:
    """Tags 36867, 306 and 272 of an Exif block, either byte order; 36867 stands in the Exif directory. A directory is read once,
    however often others point to it."""
    if not data.startswith(b"Exif\0\0"):
        return None, None, None
    tiff = data[6:]
    order = "<" if tiff[:2] == b"II" else ">"
    found: dict[int, str] = {}
    seen: set[int] = set()
    try:
        todo = [struct.unpack_from(order + "I", tiff, 4)[0]]
        while todo:
            offset = todo.pop()
            if offset in seen:
                continue
            seen.add(offset)
            (n,) = struct.unpack_from(order + "H", tiff, offset)
            for i in range(n):
                tag, kind, count, value = struct.unpack_from(order + "HHII", tiff, offset + 2 + 12 * i)
                if tag == 34665:
                    todo.append(value)
                elif tag in (36867, 306, 272) and kind == 2:
                    start = value if count > 4 else offset + 2 + 12 * i + 8
                    found.setdefault(tag, tiff[start : start + count].rstrip(b"\0").decode("latin-1"))
    except struct.error:
        pass
    return found.get(36867), found.get(306), found.get(272)


def tags_of(file: pa.NativeFile | BytesIO) -> tuple[str | None, str | None, str | None, int]:
    """The three tags of a JPEG and the bytes read for them."""
    ranges = Ranges(file)
    return (*header_tags(exif_block(ranges) or b""), ranges.taken)


class Files(InputPartition):
    def __init__(self, glob: str, paths: list[str]):
        self.glob, self.paths = glob, paths


class HeaderReader(DataSourceReader):
    def __init__(self, globs: list[str], files: int):
        self.globs, self.files = globs, files

    def partitions(self) -> list[Files]:
        out = []
        for glob in self.globs:
            system, pattern, _ = opened(glob)
            paths = [path for path, _ in matched(system, pattern)]
            out += [Files(glob, paths[k : k + self.files]) for k in range(0, len(paths), self.files)]
        return out or [Files(self.globs[0], [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _, prefix = opened(partition.glob)
        rows = []
        for path in partition.paths:
            with system.open_input_file(path) as file:
                rows.append((prefix + path.lstrip("/"), *tags_of(file)))
        kinds = [pa.string()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "taken", "changed", "camera", "bytes_read"])


class ImageHeaders(DataSource):
    """`image_headers`: a row (path, taken, changed, camera, bytes_read) for each file of the option `globs`, a JSON list. Files are
    listed when the read is planned and dealt over tasks of the option `files`, 256; a task opens its files and reads ranges."""

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeaderReader(json.loads(self.options["globs"]), int(self.options.get("files", FILES)))
