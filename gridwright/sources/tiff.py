"""TIFF images without compression: gray, RGB, RGBA and CMYK of 8, 16 and 32 bits, whole numbers and fractions.

The cells of an image lie in a file row after row, so tasks write their slabs at
their places behind a header that is known beforehand (:mod:`.raw`).  Tasks read ranges
of cells, wherever their strips lie, of a file in a folder that all machines see;
elsewhere a file is one task's work to read, in ranges too.
"""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.errors import GridError
from gridwright.operators.grid import Grid
from gridwright.sources import raw

# fixed values: tags, their types' sizes and letters, how samples are numbers, and what channels mean
WIDTH, HEIGHT, BITS, PACKED, MEANING, OFFSETS, CHANNELS, ROWS, COUNTS, PLANES, EXTRA, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 338, 339
TYPES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}
FORMATS = {"u": 1, "i": 2, "f": 3}
MEANINGS = {"gray": 1, "rgb": 2, "rgba": 2, "cmyk": 5}
KINDS = ("8U", "8S", "16U", "16S", "32U", "32S", "32F", "64D")


def _header(size: tuple[int, int], kind: str, channels: int, meaning: str) -> bytes:
    """Everything in front of the cells."""
    dtype = np.dtype(raw.KINDS[kind])
    total = size[0] * size[1] * channels * dtype.itemsize
    if total >= 1 << 32:
        raise GridError("files of this kind end at 4 GB")
    tags = [(WIDTH, 4, [size[0]]), (HEIGHT, 4, [size[1]]), (BITS, 3, [8 * dtype.itemsize] * channels), (PACKED, 3, [1]), (MEANING, 3, [MEANINGS[meaning]]), (OFFSETS, 4, [0]), (CHANNELS, 3, [channels]), (ROWS, 4, [size[1]]), (COUNTS, 4, [total]), (PLANES, 3, [1]), (FORMAT, 3, [FORMATS[dtype.kind]] * channels)]
    if meaning == "rgba":
        tags.append((EXTRA, 3, [2]))
    tags.sort()
    more_at = 8 + 2 + 12 * len(tags) + 4
    more = b""
    begin = more_at + sum(len(v) * TYPES[t][0] + 3 for _, t, v in tags if len(v) * TYPES[t][0] > 4)
    begin = -(-begin // 16) * 16
    out = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(tags))
    for tag, t, values in tags:
        values = [begin] if tag == OFFSETS else values
        data = struct.pack(f"<{len(values)}{TYPES[t][1]}", *values)
        if len(data) > 4:
            data, more = struct.pack("<I", more_at + len(more)), more + data + b"\0" * (-len(data) % 4)
        out += struct.pack("<HHI", tag, t, len(values)) + data.ljust(4, b"\0")
    return (out + struct.pack("<I", 0) + more).ljust(begin, b"\0")


def write(g: Grid, path: str, kind: str, meaning: str | None = None, cells_per_slab: int = 1 << 20) -> None:
    """A two-dimensional grid (arrays: channels) as a file in a folder that all machines see.

    ``meaning``: gray, rgb, rgba or cmyk; by the number of channels unless it is given (four: rgba).
    """
    channels = 1
    if g.kind.typeName() == "array":
        channels = len(g.settled().df.select("v").first().v)
    meaning = meaning or {1: "gray", 3: "rgb", 4: "rgba"}.get(channels)
    if kind not in KINDS or g.dimension != 2 or {"gray": 1, "rgb": 3, "rgba": 4, "cmyk": 4}.get(meaning) != channels:
        raise GridError(f"{channels} channels of {kind} as {meaning} in {g.dimension} dimensions")
    width = np.dtype(raw.KINDS[kind]).itemsize * channels
    raw.in_place(raw.slabs(g, kind, cells_per_slab), path, _header(g.size, kind, channels, meaning), width * cells_per_slab, width * g.element_count)


def _tags(content: bytes | mmap.mmap) -> tuple[str, dict[int, tuple[int, ...]]]:
    """Byte order, and the first image's tags."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if not order or struct.unpack(f"{order}H", content[2:4])[0] != 42:
        raise GridError("no TIFF file")
    (at,) = struct.unpack(f"{order}I", content[4:8])
    (n,) = struct.unpack(f"{order}H", content[at : at + 2])
    found = {}
    for i in range(n):
        entry = content[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, t, count = struct.unpack(f"{order}HHI", entry[:8])
        if t in TYPES:
            size = count * TYPES[t][0]
            data = entry[8 : 8 + size]
            if size > 4:
                (where,) = struct.unpack(f"{order}I", entry[8:12])
                data = content[where : where + size]
            found[tag] = struct.unpack(f"{order}{count}{TYPES[t][1]}", data)
    return order, found


RANGE = 1 << 16
"""Cells that are read at once."""


class Layout:
    """Where the cells of a file lie, and what they are; ``content`` is read where its tags say."""

    def __init__(self, content: bytes | mmap.mmap):
        order, tags = _tags(content)
        one = lambda tag, default: tags.get(tag, (default,))[0]
        self.channels, bits, planes = one(CHANNELS, 1), set(tags.get(BITS, (1,))), one(PLANES, 1)
        form = {v: k for k, v in FORMATS.items()}.get(one(FORMAT, 1))
        self.meaning = {(0, 1): "white is zero", (1, 1): "gray", (2, 3): "rgb", (2, 4): "rgba", (5, 4): "cmyk"}.get((one(MEANING, 1), self.channels))
        if one(PACKED, 1) != 1 or len(bits) > 1 or not form or not self.meaning or (planes != 1 and self.channels > 1) or not bits <= {8, 16, 32, 64}:
            raise GridError(f"tags {tags}")
        self.dtype = np.dtype(f"{order}{form}{bits.pop() // 8}")
        self.size = (tags[WIDTH][0], tags[HEIGHT][0])
        self.offsets = np.array(tags[OFFSETS], np.int64)
        self.ends = np.cumsum(np.array(tags[COUNTS], np.int64))  # of the strips, put one behind the other
        if self.ends[-1] < self.size[0] * self.size[1] * self.channels * self.dtype.itemsize:
            raise GridError("the strips don't hold all cells")

    def cells(self, content: bytes | mmap.mmap, first: int, end: int) -> np.ndarray:
        """The cells from linear index ``first`` to ``end``, a row for each."""
        width = self.channels * self.dtype.itemsize
        at, stop, parts = first * width, end * width, []
        while at < stop:
            strip = int(np.searchsorted(self.ends, at, "right"))
            upto = min(stop, int(self.ends[strip]))
            left = int(self.ends[strip] - at)
            begin = int(self.offsets[strip]) + int(self.ends[strip] - (self.ends[strip - 1] if strip else 0)) - left
            parts.append(content[begin : begin + upto - at])
            at = upto
        return np.frombuffer(b"".join(parts), self.dtype).reshape(-1, self.channels)


def decoded(content: bytes) -> tuple[np.ndarray, str]:
    """Rows, columns and channels of a file's content, and what the channels mean."""
    layout = Layout(content)
    width, height = layout.size
    return layout.cells(content, 0, width * height).reshape(height, width, layout.channels), layout.meaning


def read(spark: SparkSession, path: str) -> tuple[Grid, str]:
    """A file as a grid (several channels are an array), and what its channels mean."""
    here = path.removeprefix("file://").removeprefix("file:")
    if not os.path.isfile(here):
        return _read_whole(spark.read.format("binaryFile").load(path))
    with open(here, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as content:
        layout = Layout(content)
    n = layout.size[0] * layout.size[1]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(here, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as content:  # an error where the folder isn't seen
            for b in batches:
                for at in b.column(0).to_pylist():
                    yield raw.batch_of(layout.cells(content, at, min(n, at + RANGE)), at, layout.size)

    ranges = spark.range(0, n, RANGE, min(MOST_TASKS, -(-n // RANGE)))
    return Grid(ranges.mapInArrow(cells, _schema(layout.channels, layout.dtype.kind)), layout.size), layout.meaning


MOST_TASKS = 4096


def _schema(channels: int, kind: str) -> str:
    element = "double" if kind == "f" else "bigint"
    return f"x bigint, y bigint, v {f'array<{element}>' if channels > 1 else element}"


def _read_whole(file: DataFrame) -> tuple[Grid, str]:
    """The same from where tasks can't open files."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                found = Layout(content.as_py())
                yield pa.RecordBatch.from_pydict({"w": [found.size[0]], "h": [found.size[1]], "c": [found.channels], "k": [found.dtype.kind], "m": [found.meaning]})

    known = file.select("content").mapInArrow(first, "w bigint, h bigint, c bigint, k string, m string").first()
    n = known.w * known.h

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                layout = Layout(data)
                for at in range(0, n, RANGE):
                    yield raw.batch_of(layout.cells(data, at, min(n, at + RANGE)), at, layout.size)

    return Grid(file.select("content").mapInArrow(cells, _schema(known.c, known.k)), (known.w, known.h)), known.m


def cmyk_to_rgb(g: Grid, most: int = 255) -> Grid:
    """Cyan, magenta, yellow and black, whole numbers up to ``most``, as red, green and blue: what each ink and the black let through, rounded down."""
    v = g.value
    left = F.lit(most).cast("bigint") - v[3].cast("bigint")
    return g.with_value(F.array(*(F.floor((F.lit(most).cast("bigint") - v[i].cast("bigint")) * left / F.lit(most)) for i in range(3))))
