"""Raw files by ranges, PNG files, indexed cells, ordered reductions, locators between cells, quaternion columns."""

import io
import math
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.errors import GridError
from gridwright.operators import quaternion, reduce, stencil
from gridwright.operators.grid import Grid
from gridwright.operators.quaternion import Quaternion
from gridwright.sources import png, raw, tables, tiff
from gridwright.sources import procedural as p


def arr(g):
    return tables.to_array(g)


# --- raw files


@pytest.mark.parametrize(("size", "kind"), [((70_000,), "32S"), ((300, 200), "16U"), ((40, 30, 50), "64D"), ((7919,), "8U"), ((65_537,), "16S"), ((1,), "32F")])
def test_raw_files_of_many_ranges(spark, tmp_path, size, kind):
    g = p.unique_id(spark, size)
    g = g.with_value(g.value % 251)
    path = raw.dump(g, str(tmp_path / "a"), kind, 1000)
    assert os.listdir(tmp_path) == [os.path.basename(path)]
    with open(path, "rb") as f:
        assert (np.frombuffer(f.read(), raw.KINDS[kind]) == arr(g).reshape(-1)).all()
    again = raw.load(spark, path)
    assert again.size == (size if len(size) > 1 else (*size, 1)) and (arr(again).reshape(-1) == arr(g).reshape(-1)).all()
    again.validate()


def test_a_file_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    g = p.unique_id(spark, (512, 1000))
    path = raw.dump(g, str(tmp_path / "a"), "32S", 1 << 17)
    monkeypatch.setattr(raw, "RANGE", 300_000)
    again = raw.load(spark, path)
    assert again.df.rdd.getNumPartitions() >= 6 and reduce.total(again).first().v == sum(range(512_000))


def test_several_tasks_write_a_file(spark, tmp_path):
    g = p.unique_id(spark, (100, 100))
    slabs = raw.slabs(g, "32S", 500)
    assert slabs.count() == 20
    path = raw.dump(g, f"file://{tmp_path}/b", "32S", 500)
    assert (arr(raw.load(spark, path)) == arr(g)).all()


def test_channels_and_complex_numbers(spark, tmp_path):
    g = p.generated(spark, (9, 8), lambda at: F.array(at[0], at[1], at[0] * at[1]))
    path = raw.dump(g, str(tmp_path / "c"), "16S", 10)
    assert path.endswith("_16SC3_9x8.raw") and (arr(raw.load(spark, path)) == arr(g)).all()
    c = p.generated(spark, (5, 4), lambda at: F.struct(at[0].cast("double").alias("re"), (-at[1]).cast("double").alias("im")))
    assert (arr(raw.load(spark, raw.dump(c, str(tmp_path / "d"), "64C"))) == arr(c)).all()


def test_wrong_files(spark, tmp_path):
    path = raw.dump(p.unique_id(spark, (6, 4)), str(tmp_path / "a"), "32S")
    with pytest.raises(GridError, match="bytes"):
        raw.load(spark, path, "32S", (5, 4))
    with pytest.raises(GridError, match="dump_slabs"):
        raw.dump(p.unique_id(spark, (6, 4)), "hdfs://somewhere/a", "32S")
    with pytest.raises(Exception, match="don't fit"):
        raw.dump(p.constant(spark, -1, (3, 3)), str(tmp_path / "b"), "8U")
    lacking = p.unique_id(spark, (6, 4)).settled()
    with pytest.raises(GridError, match="written of"):
        raw.dump(Grid(lacking.df.where("x < 5"), (6, 4)), str(tmp_path / "c"), "32S")
    assert len(os.listdir(tmp_path)) == 1  # nothing half-written stays


def test_records_divide_files():
    assert raw._record(1 << 20) == 1 << 16 and raw._record(12) == 12 and raw._record(2 * 65_537) == 2 and raw._record(1) == 1


# --- PNG


def image(spark, a):
    height, width, channels = a.shape
    rows = [(x, y, a[y, x].tolist() if channels > 1 else a[y, x, 0].item()) for y in range(height) for x in range(width)]
    return Grid(spark.createDataFrame(rows, f"x bigint, y bigint, v {'array<bigint>' if channels > 1 else 'bigint'}").repartition(3), (width, height)), sorted(rows)


@pytest.mark.parametrize("bits", [8, 16])
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_layouts(spark, tmp_path, channels, bits, monkeypatch):
    rng = np.random.default_rng(channels * bits)
    smooth = np.add.outer(np.arange(21) * 3, np.arange(17))[..., None] + np.arange(channels)
    a = np.where(np.arange(21)[:, None, None] % 5 == 0, rng.integers(0, 1 << bits, (21, 17, channels)), smooth)
    monkeypatch.setattr(png, "ROWS", 4)
    g, rows = image(spark, a)
    path = str(tmp_path / "a.png")
    png.write(g, path, bits)
    again = png.read(spark, path)
    assert again.size == (17, 21) and sorted(tuple(r) for r in again.cells.collect()) == rows
    with open(path, "rb") as f:
        data = f.read()
    assert len({f for f in _filters(data, 17 * channels * bits // 8)}) > 1


def _parts(data):
    at = 8
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def _filters(data, width):
    """Filters of the rows; the stream as a whole must be sound, its check sum too."""
    stream = zlib.decompress(b"".join(d for n, d in _parts(data) if n == b"IDAT"))
    return stream[:: width + 1]


def test_png_by_definition(tmp_path, spark):
    """A file made here, with every filter."""
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 256, (10, 12), dtype=np.uint8)  # 4 pixels of 3 channels
    lines = b""
    for y, row in enumerate(rows.astype(int)):
        kind = y % 5
        up = rows[y - 1].astype(int) if y else np.zeros(12, int)
        line = []
        for i in range(12):
            a, c = (row[i - 3], up[i - 3]) if i >= 3 else (0, 0)
            b = up[i]
            near = min((abs(a + b - c - v), k) for k, v in enumerate((a, b, c)))[1]
            line.append(int(row[i] - [0, a, b, (a + b) // 2, (a, b, c)[near]][kind]) % 256)
        lines += bytes([kind, *line])
    file = io.BytesIO()
    file.write(png.SIGNATURE)
    for name, data in ((b"IHDR", struct.pack(">IIBBBBB", 4, 10, 8, 2, 0, 0, 0)), (b"tEXt", b"a\0b"), (b"IDAT", zlib.compress(lines)[:20]), (b"IDAT", zlib.compress(lines)[20:]), (b"IEND", b"")):
        file.write(struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data)))
    path = tmp_path / "b.png"
    path.write_bytes(file.getvalue())
    assert (arr(png.read(spark, str(path))) == rows.reshape(10, 4, 3)).all()
    damaged = bytearray(file.getvalue())
    damaged[-30] ^= 1
    with pytest.raises(GridError, match="damaged"):
        png.decoded(bytes(damaged))
    for head in (b"GIF89a" + bytes(40), file.getvalue()[:25] + b"\x03" + bytes(9)):
        with pytest.raises(GridError):
            png.header(head)


def test_png_refuses_what_does_not_fit(spark, tmp_path):
    for g, bits in ((p.constant(spark, 1, (3, 3, 3)), 8), (p.constant(spark, 1, (3, 3)), 4), (p.index_view(spark, (2, 2)).with_value(F.array(*[F.lit(1)] * 5)), 8)):
        with pytest.raises(GridError):
            png.write(g, str(tmp_path / "x.png"), bits)
    with pytest.raises(Exception, match="don't fit"):
        png.write(p.constant(spark, 256, (3, 3)), str(tmp_path / "x.png"))


def test_check_sums_join():
    rng = random.Random(1)
    for _ in range(50):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.randrange(0, 9000))) for _ in range(2))
        assert png._joined_sum(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


# --- TIFF


@pytest.mark.parametrize(("channels", "kind", "meaning"), [(1, "8U", None), (1, "32S", "gray"), (1, "64D", None), (3, "16U", None), (3, "32F", "rgb"), (4, "8S", None), (4, "32U", "cmyk"), (4, "16S", "rgba")])
def test_tiff_layouts(spark, tmp_path, channels, kind, meaning):
    rng = np.random.default_rng(channels)
    dtype = np.dtype(raw.KINDS[kind])
    a = rng.random((11, 7, channels)).astype(dtype).astype(float) if dtype.kind == "f" else rng.integers(np.iinfo(dtype).min, np.iinfo(dtype).max + 1, (11, 7, channels), dtype=np.int64)
    element = "double" if dtype.kind == "f" else "bigint"
    rows = [(x, y, a[y, x].tolist() if channels > 1 else a[y, x, 0].item()) for y in range(11) for x in range(7)]
    g = Grid(spark.createDataFrame(rows, f"x bigint, y bigint, v {f'array<{element}>' if channels > 1 else element}").repartition(3), (7, 11))
    path = str(tmp_path / "a.tif")
    tiff.write(g, path, kind, meaning, 9)
    again, means = tiff.read(spark, path)
    assert again.size == (7, 11) and means == (meaning or {1: "gray", 3: "rgb", 4: "rgba"}[channels])
    assert sorted(tuple(r) for r in again.cells.collect()) == sorted(rows)


def test_tiff_of_others(spark, tmp_path):
    """The high byte first, in two strips, with the tags at the end."""
    a = np.arange(6 * 5, dtype=">u2").reshape(5, 6)
    one, two = a[:3].tobytes(), a[3:].tobytes()
    tags = [(256, 3, 6), (257, 3, 5), (258, 3, 16), (259, 3, 1), (262, 3, 1), (277, 3, 1), (278, 3, 3)]
    at = 8 + len(one) + len(two)
    body = b"".join(struct.pack(">HHIHH", t, k, 1, v, 0) for t, k, v in tags[:5]) + struct.pack(">HHII", 273, 4, 2, at) + b"".join(struct.pack(">HHIHH", t, k, 1, v, 0) for t, k, v in tags[5:]) + struct.pack(">HHIHH", 279, 3, 2, len(one), len(two))
    data = b"MM" + struct.pack(">HI", 42, at + 8) + one + two + struct.pack(">II", 8, 8 + len(one)) + struct.pack(">H", 9) + body + bytes(4)
    (tmp_path / "b.tif").write_bytes(data)
    g, means = tiff.read(spark, str(tmp_path / "b.tif"))
    assert means == "gray" and (arr(g) == a).all()
    for wrong in (b"GIF8" + bytes(30), data.replace(struct.pack(">HHIHH", 259, 3, 1, 1, 0), struct.pack(">HHIHH", 259, 3, 1, 5, 0))):
        with pytest.raises(GridError):
            tiff.decoded(wrong)
    with pytest.raises(GridError):
        tiff.write(g, str(tmp_path / "c.tif"), "16U", "cmyk")
    with pytest.raises(GridError, match="4 GB"):
        tiff._header((70_000, 70_000), "8U", 1, "gray")


@pytest.mark.parametrize("rows_per_strip", [1, 3, 50])
def test_tiff_ranges_lie_across_strips(spark, tmp_path, rows_per_strip):
    """Strips in reverse order with gaps between them; ranges begin and end inside of rows and strips."""
    a = np.arange(13 * 50 * 3, dtype="<u2").reshape(50, 13, 3)
    strips = [a[y : y + rows_per_strip].tobytes() for y in range(0, 50, rows_per_strip)]
    body, places = b"", {}
    for i in reversed(range(len(strips))):
        body += b"\xee" * 5
        places[i] = 8 + len(body)
        body += strips[i]
    body += b"\0" * (len(body) % 2)
    lists = b"".join(struct.pack("<I", places[i]) for i in range(len(strips))) + b"".join(struct.pack("<I", len(x)) for x in strips) + struct.pack("<3H", 16, 16, 16)
    at, n = 8 + len(body), len(strips)
    where = (places[0], len(strips[0])) if n == 1 else (at, at + 4 * n)
    tags = [(256, 4, 1, 13), (257, 4, 1, 50), (258, 3, 3, at + 8 * n), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, n, where[0]), (277, 3, 1, 3), (278, 4, 1, rows_per_strip), (279, 4, n, where[1])]
    data = b"II" + struct.pack("<HI", 42, at + len(lists)) + body + lists + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4)
    layout = tiff.Layout(data)
    for first, end in ((0, 650), (0, 1), (7, 40), (38, 39), (649, 650), (12, 600)):
        assert (layout.cells(data, first, end) == a.reshape(-1, 3)[first:end]).all()
    (tmp_path / "s.tif").write_bytes(data)
    for g, means in (tiff.read(spark, str(tmp_path / "s.tif")), tiff._read_whole(spark.read.format("binaryFile").load(str(tmp_path / "s.tif")))):
        assert means == "rgb" and (arr(g) == a).all()


def test_tiff_is_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "big.tif")
    tiff.write(p.unique_id(spark, (500, 600)), path, "32U")
    g, _ = tiff.read(spark, path)
    tasks = g.cells.groupBy(F.spark_partition_id()).count().count()
    assert tasks >= 4 and reduce.total(g.with_value(g.value * F.col("x"))).first()[0] == sum(i * (i % 500) for i in range(300_000))


def test_inks(spark):
    g = p.generated(spark, (2, 2), lambda at: F.array(at[0] * 255, at[1] * 100, F.lit(0), at[0] * at[1] * 55))
    assert arr(tiff.cmyk_to_rgb(g)).tolist() == [[[255, 255, 255], [0, 255, 255]], [[255, 155, 255], [0, 155 * 200 // 255, 200]]]


# --- indexed cells


def test_cells_by_their_index(spark, tmp_path):
    g = p.unique_id(spark, (20, 30)).with_value(F.col("x") * 100 + F.col("y"))
    index = tables.Indexed.write(g, str(tmp_path / "i"), 64)
    assert index.at(7, 21) == 721 and index.at(0, 0) == 0 and index.at(19, 29) == 1929
    flat = arr(g).reshape(-1)
    assert sorted((r.i, r.v) for r in index.between(60, 70).collect()) == [(i, flat[i]) for i in range(60, 70)]
    assert index.between(5, 5).count() == 0 and index.between(0, 600).count() == 600
    with pytest.raises(GridError):
        index.between(0, 601)
    asked = spark.createDataFrame([(5, "a"), (5, "b"), (599, "c"), (None, "d"), (700, "e")], "i bigint, v0 string")
    assert sorted((r.v0, r.v) for r in index.of(asked).collect()) == [("a", flat[5]), ("b", flat[5]), ("c", flat[599])]


def test_few_cells_touch_one_folder(spark, tmp_path):
    index = tables.Indexed.write(p.unique_id(spark, (100, 100)), str(tmp_path / "i"), 1000)
    few = index.between(2500, 2510)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan and "PushedFilters: [IsNotNull(i)" in plan
    files = few.select("v", F.input_file_name().alias("f")).select("f").distinct().collect()
    assert len(files) == 1 and "block=2/" in files[0].f
    scans = [x for x in _scans(few._jdf.queryExecution().executedPlan())]
    few.collect()
    assert not scans or all(s <= 1 for s in scans)


def _scans(plan):
    """Files that each scan of a plan has read."""
    metrics = plan.metrics()
    if metrics.contains("numFiles"):
        yield metrics.apply("numFiles").value()
    children = plan.children()
    for i in range(children.size()):
        yield from _scans(children.apply(i))


def test_no_large_arrays_on_the_driver(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "MOST_ON_DRIVER", 10)
    with pytest.raises(GridError):
        arr(p.constant(spark, 1, (11,)))
    monkeypatch.setattr(tables, "MOST_ROWS", 2)
    (tmp_path / "k.txt").write_text("1 2\n3 4\n5 6\n")
    with pytest.raises(GridError):
        tables.read_kernel(spark, str(tmp_path / "k.txt"))


# --- ordered reductions


@pytest.mark.parametrize("cells", [1, 12, 1 << 16])
@pytest.mark.parametrize(("size", "axis"), [((6, 3), 0), ((2, 5), 1), ((4, 5, 7), 2)])
def test_any_operator_along_an_axis(spark, size, axis, cells):
    g = p.unique_id(spark, size)
    g = g.with_value((g.value * 37 + 5) % 60 * 6)
    a = arr(g)
    got = reduce.reduce_along(g, axis, np.gcd.reduce, cells)
    assert (arr(got) == np.gcd.reduce(a, a.ndim - 1 - axis)).all()


@pytest.mark.parametrize("cells", [3, 1 << 16])
def test_operators_need_not_commute(spark, cells):
    g = p.unique_id(spark, (6, 40))
    g = g.with_value(F.when(g.value % 7 == 0, g.value + 1).otherwise(0))
    a = arr(g)

    def last(block, axis):
        turned = np.moveaxis(block, axis, -1)[..., ::-1]
        return np.take_along_axis(turned, (turned != 0).argmax(-1)[..., None], -1)[..., 0]

    got = arr(reduce.reduce_along(g.settled(), 1, last, cells))
    assert got.tolist() == [next((v for v in a[::-1, x] if v), 0) for x in range(6)]


# --- locators between cells


def test_locator_between_cells(spark):
    g = p.generated(spark, (6, 5), lambda at: (at[0] * 10 + at[1] * at[1]).cast("double"))
    a = np.pad(arr(g), 2, mode="edge")
    got = arr(stencil.transform_locator(g, (1, 2), (2, 1), lambda at: at(0.25, -1.5) + at(1.5, 0)))
    for y in range(5):
        for x in range(6):
            near = lambda dx, dy: a[y + 2 + dy, x + 2 + dx]  # noqa: B023, E731
            want = 0.375 * near(0, -2) + 0.125 * near(1, -2) + 0.375 * near(0, -1) + 0.125 * near(1, -1) + 0.5 * near(1, 0) + 0.5 * near(2, 0)
            assert math.isclose(got[y, x], want)
    with pytest.raises(GridError):
        stencil.transform_locator(g, (1, 1), (1, 1), lambda at: at(0.5, 1.5))


# --- quaternion columns


def test_quaternion_columns(spark):
    rng = random.Random(3)
    rows = [[rng.uniform(-2, 2) for _ in range(7)] for _ in range(40)] + [[0.0] * 4 + [1.0, 2.0, 3.0], [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]]
    df = spark.createDataFrame(rows, [*"wxyzabc"])
    q, v = quaternion.column(*(F.col(c) for c in "wxyz")), [F.col(c) for c in "abc"]
    turned = quaternion.rotated_by_column(quaternion.between_columns([F.col(c) for c in "xyz"], v), [F.col(c) for c in "xyz"])
    out = df.select(*"wxyzabc", quaternion.inverse_column(q).alias("i"), quaternion.rotated_by_column(q, v).alias("r"), turned.alias("t"), quaternion.conjugate_column(q).alias("k")).collect()
    for r in out:
        own = Quaternion(r.w, r.x, r.y, r.z)
        assert tuple(r.k) == (r.w, -r.x, -r.y, -r.z)
        if not own.squared:
            assert r.i is None
            continue
        back = own.inverted()
        assert np.allclose([r.i.w, r.i.x, r.i.y, r.i.z], [back.w, back.x, back.y, back.z])
        want = own * Quaternion(0.0, r.a, r.b, r.c) * back
        assert np.allclose([r.r.x, r.r.y, r.r.z], [want.x, want.y, want.z])
        one, two = np.array([r.x, r.y, r.z]), np.array([r.a, r.b, r.c])
        if np.linalg.norm(one) and np.linalg.norm(two):
            assert np.allclose([r.t.x, r.t.y, r.t.z], two / np.linalg.norm(two) * np.linalg.norm(one))
    opposite = spark.range(1).select(quaternion.between_columns([F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(-2.0), F.lit(0.0), F.lit(0.0)]).alias("q"))
    assert opposite.first().q is None
