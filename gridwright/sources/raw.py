"""Raw array files, PGM, PPM, PAM and PFM images, and grids of them.

A raw file has no header: its name ends in the element's kind and the size,
``prefix_32F_12x16.raw``.  It is read in records of equal length, by as many tasks as
it has byte ranges of :data:`RANGE`, wherever Spark reads.  It is written by tasks
too: each puts its slabs at their places in a file in a folder that all machines
see, and the file gets its name when all are there.  Image files are one task's
work to read.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.errors import GridError
from gridwright.functions.shapes import AXES, element_count, linear_column
from gridwright.operators.grid import Grid

# fixed values: kinds of elements as file names tell them, and numpy's types
KINDS = {"8U": "<u1", "8S": "<i1", "16U": "<u2", "16S": "<i2", "32U": "<u4", "32S": "<i4", "32F": "<f4", "64D": "<f8", "64C": "<c8", "64Z": "<c8"}
NAME = re.compile(r"_(\d+[USFDCZ])(?:C(\d+))?_(\d+)x(\d+)(?:x(\d+))?\.raw$")


def file_name(prefix: str, kind: str, size: Sequence[int], channels: int = 1) -> str:
    """``prefix_<kind>[C<channels>]_<sx>x<sy>[x<sz>].raw``; one axis is written as ``<n>x1``."""
    shape = "x".join(map(str, size)) + ("x1" if len(size) == 1 else "")
    return f"{prefix}_{kind}{f'C{channels}' if channels > 1 else ''}_{shape}.raw"


def parsed(name: str) -> tuple[str, tuple[int, ...], int]:
    """Kind, size and channels of a file's name."""
    m = NAME.search(name)
    if not m:
        raise GridError(f"{name!r} tells no kind and size")
    size = tuple(int(x) for x in m.groups()[2:] if x)
    return m[1], size, int(m[2] or 1)


RECORD = 1 << 16
"""Cells of a record at most."""
RANGE = 32 << 20
"""Bytes of a file that a task reads."""


def _record(n: int) -> int:
    """The largest number of cells up to ``RECORD`` that divides ``n``."""
    best = 1
    for p in range(1, isqrt(n) + 1):
        if n % p == 0:
            best = max([best, *(d for d in (p, n // p) if d <= RECORD)])
    return best


def load(spark: SparkSession, path: str, kind: str | None = None, size: Sequence[int] | None = None, channels: int = 1) -> Grid:
    """A raw file as a grid; kind and size from its name unless they are given.

    Records have a length that divides the file's.  A file of a number of cells
    that only small numbers divide (a prime one) is a record as a whole.
    """
    if kind is None or size is None:
        kind, size, channels = parsed(path)
    size, n = tuple(size), element_count(size)
    width = np.dtype(KINDS[kind]).itemsize * channels
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    length = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    if length != n * width:
        raise GridError(f"{length} bytes for {n} cells of {width}")
    record = _record(n)
    if record * 256 < min(n, RECORD):
        whole = spark.read.format("binaryFile").load(path).select(F.lit(0).cast("bigint").alias("slab"), F.col("content").alias("bytes"))
        return from_slabs(whole, kind, size, n, channels)
    of = "org.apache.spark.input.FixedLengthBinaryInputFormat"
    settings = {f"{of}.recordLength": str(record * width), "mapreduce.input.fileinputformat.split.maxsize": str(max(RANGE, record * width))}
    records = spark.sparkContext.newAPIHadoopFile(path, of, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=settings)
    return from_slabs(spark.createDataFrame(records.map(lambda r: (r[0], bytearray(r[1]))), "slab bigint, bytes binary"), kind, size, record, channels)


def slabs(g: Grid, kind: str, cells_per_slab: int = 1 << 20) -> DataFrame:
    """``slab, bytes``: the raw file in pieces of whole cells, in linear order."""
    dtype = np.dtype(KINDS[kind])
    schema = pa.schema([("slab", pa.int64()), ("bytes", pa.binary())])

    def numbers(v: pa.Array) -> np.ndarray:
        """A row for each cell, by its channels."""
        if pa.types.is_struct(v.type):
            return numbers(v.field("re")) + 1j * numbers(v.field("im"))
        if pa.types.is_list(v.type):
            width = v.value_lengths().to_numpy(zero_copy_only=False)
            if v.null_count or (width != width[0]).any():
                raise GridError("cells of different numbers of channels")
            return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        return v.to_numpy(zero_copy_only=False)[:, None]

    def pack(table: pa.Table) -> pa.Table:
        a = numbers(table.column("v").combine_chunks())[np.argsort(table.column("i").to_numpy())]
        if dtype.kind in "iu" and a.size and (a.min() < np.iinfo(dtype).min or a.max() > np.iinfo(dtype).max):
            raise GridError(f"values don't fit {kind}")
        return pa.table([table.column("slab")[:1], pa.array([a.astype(dtype).tobytes()], pa.binary())], schema=schema)

    rows = g.settled().df.select(linear_column(g.size, g.dims).alias("i"), "v").withColumn("slab", F.expr(f"i div {cells_per_slab}"))
    return rows.groupBy("slab").applyInArrow(pack, "slab bigint, bytes binary")


def batch_of(a: np.ndarray, first: int, size: Sequence[int]) -> pa.RecordBatch:
    """Cells of whole numbers or fractions (a row for each, by its channels) from linear index ``first`` on."""
    columns, left = [], np.arange(len(a)) + first
    for s in size:
        columns.append(pa.array(left % s))
        left = left // s
    flat = pa.array(a.reshape(-1).astype("f8" if a.dtype.kind == "f" else "i8"))
    v = pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1], flat) if a.shape[1] > 1 else flat
    return pa.RecordBatch.from_arrays([*columns, v], names=[*AXES[: len(size)], "v"])


def from_slabs(rows: DataFrame, kind: str, size: Sequence[int], cells_per_slab: int = 1 << 20, channels: int = 1) -> Grid:
    """The grid again from ``slab, bytes``; a slab is one task's work."""
    size, dtype = tuple(size), np.dtype(KINDS[kind])
    element = "struct<re:double,im:double>" if dtype.kind == "c" else "double" if dtype.kind == "f" else "bigint"
    wide = "f8" if dtype.kind == "f" else "i8"

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for slab, content in zip(b["slab"], b["bytes"]):
                a = np.frombuffer(content, dtype)
                for at in range(0, len(a) // channels, 1 << 18):
                    part = a[at * channels : (at + (1 << 18)) * channels]
                    if dtype.kind == "c":
                        v = [{"re": float(x.real), "im": float(x.imag)} for x in part]
                    else:
                        v = list(part.astype(wide).reshape(-1, channels)) if channels > 1 else part.astype(wide)
                    out, left = {}, np.arange(len(v)) + slab * cells_per_slab + at
                    for d, s in zip(AXES, size):
                        out[d], left = left % s, left // s
                    yield pd.DataFrame({**out, "v": v})

    schema = ", ".join([*(f"{d} bigint" for d in AXES[: len(size)]), f"v {f'array<{element}>' if channels > 1 else element}"])
    return Grid(rows.select("slab", "bytes").mapInPandas(cells, schema), size)


def dump_slabs(g: Grid, path: str, kind: str, cells_per_slab: int = 1 << 20) -> None:
    """Write a grid as a Parquet table of slabs, each by its own executor; nothing passes through the driver."""
    slabs(g, kind, cells_per_slab).write.mode("overwrite").parquet(path)


def dump(g: Grid, prefix: str, kind: str, cells_per_slab: int = 1 << 20) -> str:
    """Write a raw file into a folder that all machines see; its path."""
    channels = 1
    if g.kind.typeName() == "array":
        channels = len(g.settled().df.select("v").first().v)
    path = file_name(prefix, kind, g.size, channels)
    width = np.dtype(KINDS[kind]).itemsize * channels
    in_place(slabs(g, kind, cells_per_slab), path, b"", width * cells_per_slab, width * g.element_count)
    return path


def in_place(rows: DataFrame, path: str, head: bytes, slab_bytes: int, total: int) -> None:
    """Write slabs at their places behind ``head``; a task that runs again writes the same bytes again."""
    target = path.removeprefix("file://")
    if "://" in target:
        raise GridError(f"{path}: tasks write into folders; elsewhere there is dump_slabs")
    under_way = f"{target}.{uuid.uuid4().hex}"
    with open(under_way, "wb") as f:
        f.write(head)
        f.truncate(len(head) + total)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = []
            for slab, content in zip(b.column(0).to_pylist(), b.column(1)):
                with open(under_way, "r+b") as f:  # an error where the folder isn't seen
                    f.seek(len(head) + slab * slab_bytes)
                    sizes.append(f.write(content.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["n"])

    try:
        done = rows.select("slab", "bytes").mapInArrow(put, "n bigint").agg(F.sum("n").alias("n")).first().n or 0
        if done != total:
            raise GridError(f"{done} bytes written of {total}")
        os.replace(under_way, target)
    finally:
        if os.path.exists(under_way):
            os.remove(under_way)


def _image_header(head: bytes) -> tuple[int, tuple[int, int], int, str, bool]:
    """Channels, size, where the cells begin, their type, and whether rows go from the bottom up."""
    if m := re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", head):
        return (1 if m[1] == b"5" else 3), (int(m[2]), int(m[3])), m.end(), "<u1" if int(m[4]) < 256 else ">u2", False
    if m := re.match(rb"P7\n(.*?)ENDHDR\n", head, re.S):
        field = {x.split()[0]: x.split()[1] for x in m[1].split(b"\n") if len(x.split()) > 1 and x[:1] != b"#"}
        width, height, depth, most = (int(field[x]) for x in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
        return depth, (width, height), m.end(), "<u1" if most < 256 else ">u2", False
    if m := re.match(rb"P([Ff])\s+(\d+)\s+(\d+)\s+(-?[\d.]+)\s", head):
        return (3 if m[1] == b"F" else 1), (int(m[2]), int(m[3])), m.end(), "<f4" if float(m[4]) < 0 else ">f4", True
    raise GridError("no binary PGM, PPM, PAM or PFM file")


def read_image(spark: SparkSession, path: str) -> Grid:
    """A binary PGM, PPM, PAM (any channels, as RGBA or CMYK) or PFM (floats) file; several channels are an array."""
    head = spark.read.format("binaryFile").load(path).select(F.expr("substring(content, 1, 1024)").alias("h")).first().h
    channels, size, begin, dtype, upward = _image_header(bytes(head))
    wide = "f8" if dtype[1] == "f" else "i8"

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                a = np.frombuffer(content, dtype, offset=begin, count=size[0] * size[1] * channels).astype(wide)
                i = np.arange(size[0] * size[1])
                y = i // size[0]
                v = list(a.reshape(-1, channels)) if channels > 1 else a
                yield pd.DataFrame({"x": i % size[0], "y": size[1] - 1 - y if upward else y, "v": v})

    kind = "double" if dtype[1] == "f" else "bigint"
    return Grid(spark.read.format("binaryFile").load(path).select("content").mapInPandas(cells, f"x bigint, y bigint, v {f'array<{kind}>' if channels > 1 else kind}"), size)


def write_image(g: Grid, path: str, most: int = 255, cells_per_slab: int = 1 << 20) -> None:
    """A grid of whole values 0..``most`` (or arrays) as a PGM, PPM or PAM file, of fractions as a PFM file, in a folder that all machines see."""
    channels, kind = 1, g.kind
    if kind.typeName() == "array":
        channels, kind = len(g.settled().df.select("v").first().v), kind.elementType
    if kind.typeName() in ("float", "double"):
        if channels not in (1, 3):
            raise GridError("PFM files have one channel or three")
        up = Grid(g.settled().df.withColumn("y", F.lit(g.size[1] - 1) - F.col("y")), g.size)
        head, rows, width = b"P%b\n%d %d\n-1.0\n" % (b"F" if channels == 3 else b"f", *g.size), slabs(up, "32F", cells_per_slab), 4 * channels
    else:
        rows, width = slabs(g, "8U" if most < 256 else "16U", cells_per_slab), channels * (1 if most < 256 else 2)
        if channels in (1, 3):
            head = b"P%d\n%d %d\n%d\n" % (6 if channels == 3 else 5, *g.size, most)
        else:
            head = b"P7\nWIDTH %d\nHEIGHT %d\nDEPTH %d\nMAXVAL %d\nENDHDR\n" % (*g.size, channels, most)
        if most > 255:
            rows = rows.mapInPandas(_turned, "slab bigint, bytes binary")
    in_place(rows, path, head, width * cells_per_slab, width * g.element_count)


def _turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slabs of 16-bit numbers with the high byte first."""
    for b in batches:
        yield pd.DataFrame({"slab": b["slab"], "bytes": [np.frombuffer(x, "<u2").astype(">u2").tobytes() for x in b["bytes"]]})
