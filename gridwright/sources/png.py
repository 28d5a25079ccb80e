"""PNG images: gray, gray and alpha, RGB, RGBA, of 8 or 16 bits.

An image is written band by band: each task filters and compresses its rows into a
piece of one stream, which ends at a byte, and the driver sets the pieces in order
into the file, with the check sum that theirs make.  Compressed pieces pass through
the driver one at a time.  A stream is one task's work to read, as it only makes
sense from its beginning.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.errors import GridError
from gridwright.operators.grid import Grid

# fixed values: the signature, and the colour types by channels
SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOURS = {1: 0, 2: 4, 3: 2, 4: 6}
ADLER = 65521
ROWS = 256
"""Rows of a band, fewer if the image is very wide."""


def _predicted(kind: int, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What a filter foretells of bytes from their neighbours."""
    if kind == 0:
        return np.zeros_like(left)
    if kind == 1:
        return left
    if kind == 2:
        return up
    if kind == 3:
        return (left + up) // 2
    guess = left + up - corner
    a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def filtered(rows: np.ndarray, above: np.ndarray, step: int) -> bytes:
    """Rows of bytes with the filter of the least sum of differences each; ``above`` is the row in front of the first."""
    now = rows.astype(np.int64)
    up = np.vstack([above[None], rows[:-1]]).astype(np.int64)
    left, corner = (np.pad(x, ((0, 0), (step, 0)))[:, : x.shape[1]] for x in (now, up))
    every = np.stack([(now - _predicted(kind, left, up, corner)) % 256 for kind in range(5)])
    cost = np.minimum(every, 256 - every).sum(2)
    kind = cost.argmin(0)
    best = every[kind, np.arange(len(rows))].astype(np.uint8)
    return np.hstack([kind.astype(np.uint8)[:, None], best]).tobytes()


def unfiltered(data: bytes, width: int, height: int, step: int) -> np.ndarray:
    """The rows of bytes again; ``width`` bytes each."""
    lines = np.frombuffer(data, np.uint8).reshape(height, width + 1)
    out, up = np.zeros((height, width), np.uint8), np.zeros(width, np.uint8)
    for y, line in enumerate(lines):
        kind, raw = line[0], line[1:]
        if kind == 0:
            row = raw
        elif kind == 1:
            full = np.pad(raw, (0, -width % step)).reshape(-1, step)
            row = np.cumsum(full, 0, dtype=np.uint8).reshape(-1)[:width]
        elif kind == 2:
            row = raw + up
        elif kind in (3, 4):
            row, above = raw.tolist(), up.tolist()
            for i in range(width):
                a, c = (row[i - step], above[i - step]) if i >= step else (0, 0)
                b = above[i]
                if kind == 3:
                    add = (a + b) // 2
                else:
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    add = a if p <= q and p <= r else b if q <= r else c
                row[i] = (row[i] + add) & 255
            row = np.array(row, np.uint8)
        else:
            raise GridError(f"filter {kind}")
        out[y] = up = row
    return out


def _joined_sum(first: int, second: int, size: int) -> int:
    """Adler-32 of two pieces in a row by those of each, the second of ``size`` bytes."""
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    return (b1 + b2 + size * (a1 - 1)) % ADLER << 16 | (a1 + a2 - 1) % ADLER


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def bands(g: Grid, channels: int, bits: int) -> DataFrame:
    """``band``, ``piece``, ``adler`` and ``size``: the image's stream in pieces, each made by its own task."""
    width, height = g.size
    rows = max(1, min(ROWS, (1 << 20) // width))
    step, kind = channels * bits // 8, ">u2" if bits == 16 else "u1"
    schema = pa.schema([("band", pa.int64()), ("piece", pa.binary()), ("adler", pa.int64()), ("size", pa.int64())])

    def apply(table: pa.Table) -> pa.Table:
        band = table.column("_band")[0].as_py()
        x, y = (table.column(c).to_numpy() for c in "xy")
        first = band * rows
        v = table.column("v").combine_chunks()
        v = v.flatten().to_numpy().reshape(-1, channels) if channels > 1 else v.to_numpy()[:, None]
        if len(v) and (v.min() < 0 or v.max() >= 1 << bits):
            raise GridError(f"values don't fit {bits} bits")
        cells = np.zeros((min(rows, height - first) + 1, width, channels), kind)
        cells[y - first + 1, x] = v  # the row in front is the last of the band before
        data = cells.view(np.uint8).reshape(len(cells), -1)
        raw = filtered(data[1:], data[0], step)
        press = zlib.compressobj(6, zlib.DEFLATED, -15)
        piece = press.compress(raw) + press.flush(zlib.Z_FULL_FLUSH)
        return pa.table([pa.array([band]), pa.array([piece], pa.binary()), pa.array([zlib.adler32(raw)]), pa.array([len(raw)])], schema=schema)

    own = F.expr(f"y div {rows}")
    seen = F.when((F.col("y") % rows == rows - 1) & (F.col("y") < height - 1), F.array(own, own + 1)).otherwise(F.array(own))
    return g.settled().df.select("x", "y", "v", F.explode(seen).alias("_band")).groupBy("_band").applyInArrow(apply, "band bigint, piece binary, adler bigint, size bigint")


def write(g: Grid, path: str, bits: int = 8) -> None:
    """A two-dimensional grid of whole values below ``2 ** bits`` (or arrays of up to four) as a file on the driver's machine."""
    channels = 1
    if g.kind.typeName() == "array":
        channels = len(g.settled().df.select("v").first().v)
    if channels not in COLOURS or bits not in (8, 16) or g.dimension != 2:
        raise GridError(f"{channels} channels of {bits} bits in {g.dimension} dimensions")
    whole = "array<bigint>" if channels > 1 else "bigint"
    total = 1
    with open(path, "wb") as f:
        f.write(SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", *g.size, bits, COLOURS[channels], 0, 0, 0)))
        f.write(_chunk(b"IDAT", b"\x78\x9c"))
        for r in bands(g.with_value(g.value.cast(whole)), channels, bits).orderBy("band").toLocalIterator():
            f.write(_chunk(b"IDAT", bytes(r.piece)))
            total = _joined_sum(total, r.adler, r["size"])
        last = zlib.compressobj(6, zlib.DEFLATED, -15).flush()
        f.write(_chunk(b"IDAT", last + struct.pack(">I", total)) + _chunk(b"IEND", b""))


def header(head: bytes) -> tuple[tuple[int, int], int, int]:
    """Size, channels and bits."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise GridError("no PNG file")
    width, height, bits, colour, _, _, laced = struct.unpack(">IIBBBBB", head[16:29])
    channels = {c: n for n, c in COLOURS.items()}.get(colour)
    if not channels or bits not in (8, 16) or laced:
        raise GridError(f"colour type {colour} of {bits} bits, interlaced: {laced}")
    return (width, height), channels, bits


def decoded(content: bytes) -> np.ndarray:
    """Rows, columns and channels of a file's content."""
    (width, height), channels, bits = header(content)
    at, parts = 8, []
    while at < len(content):
        (size,) = struct.unpack(">I", content[at : at + 4])
        name, data = content[at + 4 : at + 8], content[at + 8 : at + 8 + size]
        if zlib.crc32(name + data) != struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0]:
            raise GridError("a part of the file is damaged")
        if name == b"IDAT":
            parts.append(data)
        at += 12 + size
    step = channels * bits // 8
    rows = unfiltered(zlib.decompress(b"".join(parts)), width * step, height, step)
    return rows.view(">u2" if bits == 16 else "u1").reshape(height, width, channels)


def read(spark: SparkSession, path: str) -> Grid:
    """A file as a grid; several channels are an array."""
    file = spark.read.format("binaryFile").load(path)
    size, channels, _ = header(bytes(file.select(F.expr("substring(content, 1, 64)").alias("h")).first().h))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                image = decoded(bytes(content)).astype(np.int64)
                for y, row in enumerate(image):
                    yield pd.DataFrame({"x": np.arange(size[0]), "y": y, "v": list(row) if channels > 1 else row[:, 0]})

    return Grid(file.select("content").mapInPandas(cells, f"x bigint, y bigint, v {'array<bigint>' if channels > 1 else 'bigint'}"), size)
