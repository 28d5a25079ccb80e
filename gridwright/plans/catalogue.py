"""Registered queries of the array engine and the SQL each must equal.

Names begin with the number of the operator in the inventory.  Fractions that
two engines may round apart are compared as whole millionths (``v`` by
:func:`millionths`).
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions import kernels as k
from gridwright.functions.shapes import Region, coordinate_columns, largest_batch
from gridwright.operators import combine, complexes, fourier, index_space, interpolate, iterative, quaternion, render, stencil, vectors
from gridwright.operators import elementwise as e
from gridwright.operators import reduce as r
from gridwright.operators.grid import Grid
from gridwright.operators.quaternion import Quaternion, rotate_columns
from gridwright.plans import inputs as i
from gridwright.plans.inputs import COUNT, DOUBLES, HOURS, IMAGE, PAIRS, SHIPPED, VECTORS
from gridwright.sources import png, procedural, raw, tables, tiff
from gridwright.sources.shared import shared_folder

FLAGSHIP = "emb_sobel_energy"
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _add(name: str, f: Callable[[SparkSession, str], Grid | DataFrame], sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(spark, sf_dir)
        return out.cells if isinstance(out, Grid) else out

    run.__name__ = name
    _queries[name] = run
    if sql:
        _sql[name] = sql


def millionths(g: Grid) -> Grid:
    return g.with_value(F.floor(g.value * 1e6 + 0.5).cast("bigint"))


def singles(g: Grid) -> Grid:
    """In the single precision of the tables' elements: what a transform and its inverse give back is off by its last bits, which decide halves of a millionth."""
    return g.with_value(g.value.cast("float").cast("double"))


def _mq(x: str) -> str:
    return f"CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT)"


def _img(expression: str, source: str = IMAGE, tail: str = "") -> str:
    return f"WITH {source}, {COUNT} SELECT x, y, {expression} AS v FROM img, n {tail}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- sources -------------------------------------------------------------------------------------------------------

_add("s4_rows_as_image", i.embq, _img("v"))
_add("s1_s2_slab_round_trip", lambda s, d: raw.from_slabs(raw.slabs(i.embq(s, d), "32S", 10_000), "32S", (64, i.height(s, d)), 10_000), _img("v"))
_add("s12_volume_slab_round_trip", lambda s, d: raw.from_slabs(raw.slabs(i.shipped(s, d), "64D", 50), "64D", (7, 12, 7), 50).with_value(F.col("v").cast("bigint")), f"WITH {SHIPPED} SELECT x, y, z, v FROM img")


def _new_path(s) -> str:
    """A place for a file of a run, in the folder that all machines share."""
    return f"{shared_folder(s)}/files-{uuid.uuid4().hex}"


def _folder(s) -> str:
    path = _new_path(s).removeprefix("file:")
    os.makedirs(path)
    return path


def _raw_file(s, d):
    """The image as one raw file that tasks write and read by ranges."""
    return raw.load(s, raw.dump(i.embq(s, d), f"{_folder(s)}/image", "32S", 10_000))


def _raw_channels(s, d):
    """Pairs of elements as a file of two channels, into a given shape."""
    pairs = i.emb_pairs(s, d)
    g = pairs.with_value(F.array(*(F.floor(pairs.value[c] * 1000).cast("bigint") for c in ("re", "im"))))
    path = raw.dump(g, f"{_folder(s)}/pairs", "16S", 7_000)
    again = raw.load(s, path, "16S", g.size, 2)
    return again.with_value(again.value[0] * 100_000 + again.value[1])


def _png(s, d):
    path = f"{_folder(s)}/image.png"
    g = i.embq(s, d)
    png.write(g.with_value(F.pmod(g.value, F.lit(65536))), path, 16)
    return png.read(s, path)


def _inks(s, d):
    """Four elements of a row as the inks of a pixel, through a file and to red, green and blue, as one number."""
    df = i.table(s, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("y"), F.transform("embedding", lambda v: F.pmod(F.floor(v.cast("double") * 1000).cast("bigint"), F.lit(256))).alias("l"))
    cells = df.select("y", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda x: F.slice("l", 4 * x + 1, 4))).alias("x", "v"))
    path = f"{_folder(s)}/inks.tif"
    tiff.write(Grid(cells.select(F.col("x").cast("bigint").alias("x"), "y", "v"), (16, i.height(s, d))), path, "32U", "cmyk", 1_000)
    again, _ = tiff.read(s, path)
    seen = tiff.cmyk_to_rgb(again)
    return seen.settled().with_value(F.col("v")[0] * 65536 + F.col("v")[1] * 256 + F.col("v")[2])


def _text_rows(s, d):
    """The image as lines of numbers, read as a table again."""
    path = _new_path(s)
    i.table(s, d, "embeddings").select(F.concat_ws("  ", F.lit("").alias("e"), F.col("vec_id").cast("string"), F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000).cast("string"))).alias("t")).write.text(path)
    rows = tables.read_numbers(s, path).select(F.col("values")[0].cast("bigint").alias("y"), F.posexplode(F.slice("values", 2, 64)).alias("x", "v"))
    return rows.select(F.col("x").cast("bigint").alias("x"), "y", F.col("v").cast("bigint").alias("v"))


def _random_access(s, d):
    """Of every row the cell under its number, by the written index."""
    g = i.embq(s, d)
    index = tables.Indexed.write(g, _new_path(s), 5_000)
    asked = i.table(s, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("y"), (F.col("vec_id") * 64 + F.col("vec_id") % 64).cast("bigint").alias("i"))
    return index.of(asked).select("y", "v")


_add("s1_raw_file", _raw_file, _img("v"))
_add("s3_raw_channels", _raw_channels, f"WITH {PAIRS} SELECT x, y, CAST(floor(re * 1000) * 100000 + floor(im * 1000) AS BIGINT) AS v FROM img")
_add(
    "s7_inks",
    _inks,
    f"""WITH {IMAGE}, p AS (SELECT x // 4 AS x, y, list(((v % 256) + 256) % 256 ORDER BY x) AS q FROM img GROUP BY x // 4, y)
    SELECT x, y, CAST(((255 - q[1]) * (255 - q[4]) // 255) * 65536 + ((255 - q[2]) * (255 - q[4]) // 255) * 256 + (255 - q[3]) * (255 - q[4]) // 255 AS BIGINT) AS v FROM p""",
)
_add("s9_png", _png, _img("((v % 65536) + 65536) % 65536"))
_add("s10_text_table", _text_rows, _img("v"))
_add("i14_random_access", _random_access, f"WITH {IMAGE} SELECT y, v FROM img WHERE x = y % 64")
_add("s5_sparse_made_dense", i.hours, f"WITH {HOURS} SELECT x, y, z, v FROM img")
_add("s5_lineitem_volume", i.shipped, f"WITH {SHIPPED} SELECT x, y, z, v FROM img")
_add("s8_max_range", lambda s, d: r.max_range_converted(i.emb(s, d), 0, 255), f"WITH {DOUBLES}, m AS (SELECT min(v) lo, max(v) hi FROM img) SELECT x, y, CAST(trunc((v - lo) * (255.0 / (hi - lo)) + 0) AS BIGINT) AS v FROM img, m")
_add("s8_max_range_whole", lambda s, d: r.max_range_converted(i.embq(s, d), 0, 65535), f"WITH {IMAGE}, m AS (SELECT min(v) lo, max(v) hi FROM img) SELECT x, y, CAST((v - lo) * (65535 // (hi - lo)) AS BIGINT) AS v FROM img, m")
_add("s13_fill", lambda s, d: tables.filled(i.embq(s, d), 7), _img("7"))
_add("s13_clear", lambda s, d: tables.cleared(i.embq(s, d)), _img("0"))

# --- generators ----------------------------------------------------------------------------------------------------



def _shape(s, d) -> tuple[int, int]:
    """The image's size; what is generated is as large as the table and meets its cells."""
    return i.WIDTH, i.height(s, d)


_add("g1_constant", lambda s, d: i.embq(s, d) * procedural.constant(s, 5, _shape(s, d)), _img("v * 5"))
_add("g2_unique_id", lambda s, d: i.embq(s, d) + procedural.unique_id(s, _shape(s, d), 100), _img("v + 100 + x + 64 * y"))
_add("g3_checkerboard", lambda s, d: i.embq(s, d) * procedural.checkerboard(s, 1, 0, (2, 3), _shape(s, d)), _img("v * CASE WHEN (x // 2 + y // 3) % 2 = 1 THEN 1 ELSE 0 END"))
_add("g3_checkerboard_sum", lambda s, d: r.total(i.embq(s, d) * procedural.checkerboard(s, 1, 0, (2, 2), _shape(s, d))), f"WITH {IMAGE} SELECT CAST(sum(v * ((x // 2 + y // 2) % 2)) AS BIGINT) AS v FROM img")
_add("g4_sinus", lambda s, d: millionths(i.emb(s, d) + procedural.sinus(s, (1.5, 2.0), (2.0, 3.0), (0.1, 0.7), _shape(s, d))), _img(_mq("v + 1.5 * sin(2 * pi() * 2 * x / 64.0 + 0.1) + 2.0 * sin(2 * pi() * 3 * y / n.n + 0.7)"), DOUBLES))
_add("g5_mesh_grid", lambda s, d: (lambda n: combine.n_ary(lambda a, b, v: a * 1000 + b - v, *procedural.mesh_grid(s, (5, 10), (69, 10 - n)), i.embq(s, d)))(i.height(s, d)), _img("(5 + x) * 1000 + (10 - y) - v"))
_add("g6_index", lambda s, d: combine.n_ary(lambda at, v: vectors.total(at) * v, procedural.index_view(s, _shape(s, d)), i.embq(s, d)), _img("(x + y) * v"))
_add("g7_mandelbrot", lambda s, d: i.embq(s, d) + procedural.mandelbrot(s, _shape(s, d), most=60), f"WITH RECURSIVE {IMAGE}, {COUNT}, g AS (SELECT x, y, -2.0e0 + x * (3.0e0 / 64) AS cr, -1.0e0 + y * (2.0e0 / n) AS ci FROM img, n), m AS (SELECT x, y, cr, ci, 0.0e0 AS zr, 0.0e0 AS zi, 0 AS k FROM g UNION ALL SELECT x, y, cr, ci, zr * zr - zi * zi + cr, 2 * zr * zi + ci, k + 1 FROM m WHERE k < 60 AND zr * zr + zi * zi <= 4), c AS (SELECT x, y, max(k) FILTER (WHERE zr * zr + zi * zi <= 4) AS k FROM m GROUP BY x, y) SELECT x, y, CAST(v + k AS BIGINT) AS v FROM img JOIN c USING (x, y)")
_add("g8_superposed_boards", lambda s, d: i.embq(s, d) + procedural.superposed_boards(s, _shape(s, d), 4), _img(f"CAST(v + {' + '.join(f'(x // {3**p} + y // {3**p}) % 2' for p in range(4))} AS BIGINT)"))

# --- element-wise --------------------------------------------------------------------------------------------------

_add("u1_cast", lambda s, d: e.cast(e.multiply_by(i.emb(s, d), 10.0), "int"), _img("CAST(trunc(v * 10.0) AS INTEGER)", DOUBLES))
_add("u2_round", lambda s, d: e.cast(e.rounded(e.multiply_by(i.emb(s, d), 10.0)), "bigint"), _img("CAST(round(v * 10.0) AS BIGINT)", DOUBLES))
_add("u3_clamp", lambda s, d: e.clamp(i.embq(s, d), -500, 700), _img("CASE WHEN v <= -500 THEN -500 WHEN v >= 700 THEN 700 ELSE v END"))
_add("u4_normalize_complex", lambda s, d: (lambda g: millionths(g.with_value(g.value["re"] * 2 + g.value["im"])))(complexes.normalized(i.emb_pairs(s, d))), f"WITH {PAIRS} SELECT x, y, {_mq('CASE WHEN sqrt(re*re+im*im) < 1e-6 THEN 0 ELSE re/sqrt(re*re+im*im)*2 + im/sqrt(re*re+im*im) END')} AS v FROM img")
_add("u5_square", lambda s, d: e.square(i.embq(s, d)), _img("v * v"))
_add("u6_square_root", lambda s, d: e.square_root(e.absolute(i.embq(s, d))), _img("sqrt(abs(v))"))
_add("u7_multiply", lambda s, d: e.multiply_by(i.embq(s, d), 3), _img("3 * v"))
_add("u8_add", lambda s, d: e.add_value(i.embq(s, d), 17), _img("17 + v"))
_add("u9_lower_limit", lambda s, d: e.lower_limit(i.embq(s, d), 0), _img("greatest(v, 0)"))
_add("u10_lower_limit_instead", lambda s, d: e.lower_limit(i.embq(s, d), 0, -1), _img("CASE WHEN v < 0 THEN -1 ELSE v END"))
_add("u11_upper_limit", lambda s, d: e.upper_limit(i.embq(s, d), 100), _img("least(v, 100)"))
_add("u12_upper_limit_instead", lambda s, d: e.upper_limit(i.embq(s, d), 100, 9999), _img("CASE WHEN v > 100 THEN 9999 ELSE v END"))
_add("u13_absolute", lambda s, d: e.absolute(i.embq(s, d)), _img("abs(v)"))
_add("u14_magnitude", lambda s, d: millionths(complexes.magnitude(i.emb_pairs(s, d))), f"WITH {PAIRS} SELECT x, y, {_mq('sqrt(re*re + im*im)')} AS v FROM img")
_add("u15_phase", lambda s, d: millionths(complexes.phase(i.emb_pairs(s, d))), f"WITH {PAIRS} SELECT x, y, {_mq('CASE WHEN re = 0 AND im = 0 THEN 0 WHEN atan2(im, re) < 0 THEN atan2(im, re) + 2 * pi() ELSE atan2(im, re) END')} AS v FROM img")
_add("u16_conjugate", lambda s, d: (lambda g: g.with_value(g.value["re"] - g.value["im"]))(complexes.conjugated(i.emb_pairs(s, d))), f"WITH {PAIRS} SELECT x, y, re - (-im) AS v FROM img")
_add("u17_amplitude", lambda s, d: complexes.amplitude(i.emb_pairs(s, d)), f"WITH {PAIRS} SELECT x, y, re*re + im*im AS v FROM img")
_add("u18_perceptual_scale", lambda s, d: millionths(e.perceptual_scale(e.absolute(i.emb(s, d)))), _img(_mq("ln(1 + abs(v))"), DOUBLES))
_add("u19_identity", lambda s, d: e.identity(i.embq(s, d)), _img("v"))
_add("u20_increment", lambda s, d: e.increment(i.embq(s, d), 1), _img("v + 1"))
_add("u21_value_and_index", lambda s, d: e.for_each_position(i.embq(s, d), lambda v, x, y: v * (x + 1) - y), _img("v * (x + 1) - y"))
_add("u22_phase_shift", lambda s, d: (lambda g: millionths(g.with_value(g.value["re"] + 2 * g.value["im"])))(complexes.phase_shift(i.emb_pairs(s, d), (3.0, 0.0), (32, 1))), f"WITH {PAIRS}, t AS (SELECT *, -2 * pi() * 3.0 / 32 * x AS t FROM img) SELECT x, y, {_mq('(re*cos(t) - im*sin(t)) + 2 * (re*sin(t) + im*cos(t))')} AS v FROM t")
_add("u23_wiener_factor", lambda s, d: (lambda g: millionths(g.with_value(g.value["re"] - g.value["im"])))(complexes.wiener(i.emb_pairs(s, d), 0.01)), f"WITH {PAIRS} SELECT x, y, {_mq('re/(re*re+im*im+0.01) + im/(re*re+im*im+0.01)')} AS v FROM img")
_add("u24_threshold", lambda s, d: e.threshold(i.embq(s, d), 100), _img("CASE WHEN v > 100 THEN 255 ELSE 0 END"))

# --- combinations --------------------------------------------------------------------------------------------------


def _board(s, d):
    """A board of the image's size: another DataFrame, so combining takes a join."""
    return procedural.checkerboard(s, 10, 3, (4, 4), (i.WIDTH, i.height(s, d)))


_BOARD = "CASE WHEN (x // 4 + y // 4) % 2 = 1 THEN 10 ELSE 3 END"
_add("b1_add_two_sources", lambda s, d: i.embq(s, d) + _board(s, d), _img(f"v + {_BOARD}"))
_add("b1_subtract_same_source", lambda s, d: (lambda g: combine.subtract(g, e.square(g)))(i.embq(s, d)), _img("v - v * v"))
_add("b1_linear_combination", lambda s, d: combine.linear_combination(2, i.embq(s, d), -3, _board(s, d)), _img(f"2 * v - 3 * {_BOARD}"))
_add("b2_multiply", lambda s, d: combine.multiply(i.embq(s, d), _board(s, d)), _img(f"v * {_BOARD}"))
_add("b2_complex_product", lambda s, d: (lambda g: (lambda p: p.with_value(p.value["re"] - p.value["im"]))(combine.multiply(g, g)))(i.emb_pairs(s, d)), f"WITH {PAIRS} SELECT x, y, (re*re - im*im) - (re*im + im*re) AS v FROM img")
_add("b3_divide_whole", lambda s, d: i.embq(s, d) / _board(s, d), _img(f"CAST(trunc(CAST(v AS DOUBLE) / {_BOARD}) AS BIGINT)"))
_add("b3_divide_fractions", lambda s, d: (lambda g: g / (e.absolute(g) + 1.0))(i.emb(s, d)), _img("v / (abs(v) + 1.0)", DOUBLES))
_add("b4_hadamard", lambda s, d: (lambda g: (lambda p: p.with_value(p.value["re"] + p.value["im"]))(combine.hadamard(g, complexes.conjugated(g))))(i.emb_pairs(s, d)), f"WITH {PAIRS} SELECT x, y, re*re + im*(-im) AS v FROM img")
_add("b5_binary", lambda s, d: combine.binary(F.greatest, i.embq(s, d), _board(s, d).with_value(_board(s, d).value.cast("bigint"))), _img(f"greatest(v, {_BOARD})"))
_add("b6_n_ary", lambda s, d: combine.n_ary(lambda a, b, c: a + b * c, i.embq(s, d), _board(s, d), procedural.unique_id(s, (i.WIDTH, i.height(s, d)))), _img(f"v + {_BOARD} * (x + 64 * y)"))
_add("b7_zip", lambda s, d: (lambda z: z.with_value(z.value["_0"] * 2 + z.value["_1"]))(combine.zipped(i.embq(s, d), _board(s, d))), _img(f"v * 2 + {_BOARD}"))
_add("b8_zip_with_position", lambda s, d: (lambda z: z.with_value(z.value["element"] + z.value["position"][0] * z.value["position"][1]))(e.with_position(i.embq(s, d))), _img("v + x * y"))
_add("b9_operators", lambda s, d: (lambda g: 5 - (g * 2 + 1))(i.embq(s, d)), _img("5 - (v * 2 + 1)"))
_add("b10_cross_power_spectrum", lambda s, d: (lambda g: (lambda p: millionths(p.with_value(p.value["re"])))(combine.cross_power_spectrum(g, g)))(i.emb_pairs(s, d)), f"WITH {PAIRS} SELECT x, y, CAST(CASE WHEN sqrt(re*re+im*im)*sqrt(re*re+im*im) < 1e-6 THEN 0 ELSE 1000000 END AS BIGINT) AS v FROM img")

# --- index space ---------------------------------------------------------------------------------------------------

_add("i1_subview", lambda s, d: index_space.subview(i.embq(s, d), (10, 100), (20, 300)), _img("v", tail="WHERE x BETWEEN 10 AND 29 AND y BETWEEN 100 AND 399").replace("SELECT x, y, v AS v", "SELECT x - 10 AS x, y - 100 AS y, v"))
_add("i1_subview_computed", lambda s, d: i.embq(s, d) + index_space.subview(procedural.unique_id(s, (1 << 20, 1 << 20)), (1000, 2000), _shape(s, d)), _img("v + (1000 + x) + 1048576 * (2000 + y)"))
_add("i3_slice_y", lambda s, d: index_space.sliced(i.embq(s, d), 1, 7), f"WITH {IMAGE} SELECT x, v FROM img WHERE y = 7")
_add("i3_slice_volume", lambda s, d: index_space.sliced(i.shipped(s, d), 0, 3), f"WITH {SHIPPED} SELECT y AS x, z AS y, v FROM img WHERE x = 3")
_add("i4_array_subview", lambda s, d: index_space.array_subview(index_space.sliced(i.embq(s, d), 0, 5), 50, 90), f"WITH {IMAGE} SELECT y - 50 AS x, v FROM img WHERE x = 5 AND y >= 50 AND y < 90")
_add("i5_mirror", lambda s, d: index_space.mirrored(i.embq(s, d), (True, True)), _img("v").replace("SELECT x, y, v AS v", "SELECT 63 - x AS x, n.n - 1 - y AS y, v"))
_add("i5_mirror_pair_sum", lambda s, d: (lambda b: combine.add(b, index_space.mirrored(b, (True, False))))(combine.multiply(i.embq(s, d), procedural.checkerboard(s, 4, 0, (2, 2), _shape(s, d)))), _img("4 * (a.v * ((a.x // 2 + a.y // 2) % 2) + b.v * ((b.x // 2 + b.y // 2) % 2))").replace("SELECT x, y,", "SELECT a.x, a.y,").replace("FROM img, n", "FROM img a JOIN img b ON b.y = a.y AND b.x = 63 - a.x"))
_add("i6_padded", lambda s, d: index_space.padded(i.embq(s, d), (100, i.height(s, d) + 50), (-30, 20), -1), f"WITH {IMAGE}, {COUNT}, g AS (SELECT a.x, b.y FROM range(100) a(x) CROSS JOIN (SELECT unnest(range(n + 50)) AS y FROM n) b) SELECT g.x, g.y, coalesce(img.v, -1) AS v FROM g CROSS JOIN n LEFT JOIN img ON img.x = (g.x + 30) % 100 AND img.y = (g.y - 20 + n.n + 50) % (n.n + 50)")
_add("i7_swizzle", lambda s, d: index_space.swizzled(i.shipped(s, d), (2, 0, 1)), f"WITH {SHIPPED} SELECT z AS x, x AS y, y AS z, v FROM img")
_add("i11_stack", lambda s, d: index_space.stack_slice(i.shipped(s, d), 2), f"WITH {SHIPPED} SELECT x, y, v FROM img WHERE z = 2")
_add("i12_linear_index", lambda s, d: procedural.linear_ids(i.embq(s, d)), _img("x + 64 * y"))
_add("i12_reshape", lambda s, d: index_space.reshaped(i.embq(s, d), (32, 2 * i.height(s, d))), _img("v").replace("SELECT x, y, v AS v", "SELECT (x + 64 * y) % 32 AS x, (x + 64 * y) // 32 AS y, v"))
_add("i13_region_inside", lambda s, d: (lambda g: (lambda q: index_space.subview(g, q.corner, q.size))(Region((40, 3), (20, 10)).grown((1, 9), (30, 2)).clamped(g.size)))(i.embq(s, d)), f"WITH {IMAGE}, {COUNT} SELECT x - 39 AS x, y, v FROM img, n WHERE x >= 39 AND y < 15")
_add("i15_other_order", lambda s, d: (lambda g: Grid(g.settled().df.select(*(c.alias(q) for c, q in zip(reversed(coordinate_columns("(x + 64 * y)", tuple(reversed(g.size)))), "xy")), "v"), g.size))(i.embq(s, d)), _img("v").replace("SELECT x, y, v AS v", "SELECT (x + 64 * y) // n.n AS x, (x + 64 * y) % n.n AS y, v"))
_add("e6_largest_batch", lambda s, d: (lambda n: s.createDataFrame([largest_batch(1, n, 300_000, lambda k: fourier.estimated_bytes((64, k), (1,)) * k)], "rows bigint, bytes bigint"))(i.height(s, d)), f"WITH {COUNT} SELECT CAST(least(n, 300000 // 1040) AS BIGINT) AS rows, CAST(least(n, 300000 // 1040) * 1040 AS BIGINT) AS bytes FROM n")
_add("i10_bounded", lambda s, d: index_space.bounded(i.embq(s, d), (80, 20), (-8, -5), 0), f"WITH {IMAGE}, g AS (SELECT a.x, b.y FROM range(80) a(x) CROSS JOIN range(20) b(y)) SELECT g.x, g.y, coalesce(img.v, 0) AS v FROM g LEFT JOIN img ON img.x = g.x - 8 AND img.y = g.y - 5")

# --- stencils ------------------------------------------------------------------------------------------------------


def _place(c: str, d: str, n: str, border: str) -> str:
    at = f"({c} + {d})"
    if border == "repeat":
        return f"greatest(0, least({n} - 1, {at}))"
    if border == "mirror":
        return f"CASE WHEN {at} < 0 THEN -{at} WHEN {at} > {n} - 1 THEN 2 * ({n} - 1) - {at} ELSE {at} END"
    if border == "periodic":
        return f"(({at} + {n}) % {n})"
    return at


def _conv_sql(taps: list[tuple], border: str = "repeat", source: str = IMAGE, what: str = "CAST(sum(b.v * t.w) AS BIGINT)", sizes: tuple[str, ...] = ("64", "(SELECT n FROM n)")) -> str:
    """A gather: every cell joins its taps' cells."""
    dims = "xyz"[: len(sizes)]
    names = ", ".join([*(f"d{c}" for c in dims), "w"])
    rows = ", ".join(f"({', '.join(map(str, t))})" for t in taps)
    on = " AND ".join(f"b.{c} = {_place(f'a.{c}', f't.d{c}', n, border)}" for c, n in zip(dims, sizes))
    keys = ", ".join(f"a.{c}" for c in dims)
    join = "LEFT JOIN" if border == "zero" else "JOIN"
    value = what.replace("sum(b.v * t.w)", "sum(coalesce(b.v, 0) * t.w)") if border == "zero" else what
    return f"WITH {source}, {COUNT}, t({names}) AS (VALUES {rows}) SELECT {keys}, {value} AS v FROM img a CROSS JOIN t {join} img b ON {on} GROUP BY {keys}"


def _taps(kernel: k.Kernel) -> list[tuple]:
    from gridwright.functions.shapes import offsets

    return [(*o, kernel.at(o)) for _, o in offsets(kernel.size, kernel.centre)]


_BOX = k.constant(3, (3, 3))
_ASYM = k.Kernel.of([[3, 0, 1], [0, 5, 2]], (2, 1))
_FULL = k.Kernel.of([[1, 2, 3], [4, 5, 6], [7, 8, 10]])
_CUBE = k.Kernel.of([[[1, 2], [3, -4]], [[5, 0], [7, 8]], [[2, 1], [0, 3]]], (0, 0, 1))
_WIDE = k.Kernel.of([[1, -2, 3, 4, 5]], (2, 0))
_VOLUME = ("7", "12", "7")
_add("n3_conv_box", lambda s, d: stencil.convolve(i.embq(s, d), _BOX), _conv_sql(_taps(_BOX)))
_add("n3_conv_off_centre", lambda s, d: stencil.convolve(i.embq(s, d), _ASYM), _conv_sql(_taps(_ASYM)))
for _b in ("repeat", "mirror", "periodic", "zero"):
    _add(f"n2_conv_{_b}", lambda s, d, b=_b: stencil.convolve(i.embq(s, d), _FULL, b), _conv_sql(_taps(_FULL), _b))
_add("n2_conv_interior", lambda s, d: (lambda g: Grid(g.cells.where("v is not null"), g.size))(stencil.convolve(i.embq(s, d), _FULL, "none")), _conv_sql(_taps(_FULL), "inside").replace(" GROUP BY", " WHERE a.x BETWEEN 1 AND 62 AND a.y BETWEEN 1 AND (SELECT n - 2 FROM n) GROUP BY"))
_add("n3_conv_volume", lambda s, d: stencil.convolve(i.shipped(s, d), _CUBE), _conv_sql(_taps(_CUBE), "repeat", SHIPPED, sizes=_VOLUME))
_add("n3_conv_flipped", lambda s, d: stencil.convolve(i.embq(s, d), _ASYM.flipped()), _conv_sql([(-x, -y, w) for x, y, w in _taps(_ASYM)]))
_add("n3_conv_line", lambda s, d: stencil.convolve(i.embq(s, d), _WIDE), _conv_sql(_taps(_WIDE)))
_LINES = (k.Kernel.of([1, 4, 6, 4, 1]), k.Kernel.of([1, 2, 1]))
_add("n4_separable", lambda s, d: stencil.separable(i.embq(s, d), _LINES), _conv_sql(_taps(k.separable(*_LINES))))
_LINES3 = (k.Kernel.of([1, 2, 1]), k.Kernel.of([1, -1, 3]), k.Kernel.of([2, 1, 1]))
_add("n4_separable_volume", lambda s, d: stencil.separable(i.shipped(s, d), _LINES3), _conv_sql(_taps(k.separable(*_LINES3)), "repeat", SHIPPED, sizes=_VOLUME))
_add("n5_conv_by_locator", lambda s, d: stencil.for_each_locator(i.embq(s, d), (1, 1), (1, 1), lambda at: at(-1, -1) * 2 + at(0, 0) * 5 + at(1, 1) * 3), _conv_sql([(-1, -1, 2), (0, 0, 5), (1, 1, 3)]))
_GAUSS = k.gaussian_nd(1.0, 1.0)
_add("n10_gaussian", lambda s, d: millionths(stencil.separable(i.emb(s, d), (k.gaussian(1.0), k.gaussian(1.0)))), _conv_sql([(x, y, repr(w)) for x, y, w in _taps(_GAUSS)], "repeat", DOUBLES, "CAST(floor(sum(b.v * CAST(t.w AS DOUBLE)) * 1e6 + 0.5) AS BIGINT)"))
_add("n11_sobel_x", lambda s, d: stencil.convolve(i.embq(s, d), k.sobel(2, 0)), _conv_sql(_taps(k.sobel(2, 0))))
_add("n12_sobel_volume_z", lambda s, d: stencil.convolve(i.shipped(s, d), k.sobel(3, 2)), _conv_sql(_taps(k.sobel(3, 2)), "repeat", SHIPPED, sizes=_VOLUME))
_NINE = [(x, y, 1) for y in (-1, 0, 1) for x in (-1, 0, 1)]
_add("m7_median", lambda s, d: stencil.median(i.embq(s, d), (1, 1)), _conv_sql(_NINE, what="CAST(quantile_disc(b.v, 0.5) AS BIGINT)"))
_add("m7_erosion", lambda s, d: stencil.eroded(i.embq(s, d), (1, 1)), _conv_sql(_NINE, what="min(b.v)"))
_add("m7_dilation", lambda s, d: stencil.dilated(i.embq(s, d), (2, 0), "mirror"), _conv_sql([(x, 0, 1) for x in range(-2, 3)], "mirror", what="max(b.v)"))



def _edged(v: str, axis: str, other: str, low: int, high: int, n: str, f: str) -> str:
    """A window function over cells along an axis; sums count the outermost cells for those that lie outside."""
    frame = f"OVER (PARTITION BY {other} ORDER BY {axis} ROWS BETWEEN {low} PRECEDING AND {high} FOLLOWING)"
    if f != "sum":
        return f"{f}({v}) {frame}"
    line = f"OVER (PARTITION BY {other} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"sum({v}) {frame} + greatest(0, {low} - {axis}) * first_value({v}) {line} + greatest(0, {axis} + {high} - {n} + 1) * last_value({v}) {line}"


def _window_sql(f: str, low: tuple[int, int], high: tuple[int, int], factor: int = 1) -> str:
    return f"WITH {IMAGE}, {COUNT}, p AS (SELECT x, y, {_edged('v', 'x', 'y', low[0], high[0], '64', f)} AS v FROM img) SELECT x, y, CAST({factor} * ({_edged('v', 'y', 'x', low[1], high[1], '(SELECT n FROM n)', f)}) AS BIGINT) AS v FROM p"


_add("m7_erosion_wide", lambda s, d: stencil.eroded(i.embq(s, d), (25, 25)), _window_sql("min", (25, 25), (25, 25)))
_add("m7_dilation_wide", lambda s, d: stencil.dilated(i.embq(s, d), (25, 40)), _window_sql("max", (25, 40), (25, 40)))
_add("m7_median_wide", lambda s, d: stencil.median(i.embq(s, d), (4, 4), "mirror"), _conv_sql([(x, y, 1) for x in range(-4, 5) for y in range(-4, 5)], "mirror", what="CAST(quantile_disc(b.v, 0.5) AS BIGINT)"))
_add("n6_box_wide", lambda s, d: stencil.convolve(i.embq(s, d), k.constant(3, (101, 102), (50, 60))), _window_sql("sum", (50, 60), (50, 41), 3))
_DENSE = k.Kernel.of([[math.exp(-(x * x + 2 * y * y) / 90) * (1 + 0.1 * x * y) for x in range(-7, 8)] for y in range(-7, 8)])
_ROUGH = k.Kernel.of([[((x * 7 + y * 13 + x * y) % 17 - 8) / 16 for x in range(11)] for y in range(9)], (3, 4))
_WEIGHED = "CAST(floor(sum(b.v * CAST(t.w AS DOUBLE)) * 1e6 + 0.5) AS BIGINT)"
_add("n3_dense_low_rank", lambda s, d: millionths(stencil.convolve(i.emb(s, d), _DENSE, "zero")), _conv_sql([(x, y, repr(w)) for x, y, w in _taps(_DENSE)], "zero", DOUBLES, _WEIGHED))
_add("n3_dense_by_spectrum", lambda s, d: millionths(stencil.convolve(i.emb(s, d), _ROUGH, "zero")), _conv_sql([(x, y, repr(w)) for x, y, w in _taps(_ROUGH)], "zero", DOUBLES, _WEIGHED))
_add(
    "m6_transform_locator",
    lambda s, d: stencil.transform_locator(i.embq(s, d), (1, 1), (1, 1), lambda at: F.greatest(at(1, 0) - at(-1, 0), at(0, 1) - at(0, -1)), "zero"),
    f"""WITH {IMAGE}
    SELECT x, y, greatest(
      lead(v, 1, 0) OVER (PARTITION BY y ORDER BY x) - lag(v, 1, 0) OVER (PARTITION BY y ORDER BY x),
      lead(v, 1, 0) OVER (PARTITION BY x ORDER BY y) - lag(v, 1, 0) OVER (PARTITION BY x ORDER BY y)) AS v
    FROM img""",
)
_add(
    "n1_fractional_locator",
    lambda s, d: millionths(stencil.transform_locator(i.emb(s, d), (1, 2), (2, 1), lambda at: at(1.25, -1.5) - 2 * at(0, 0.75) + at(-1, 1))),
    _conv_sql([(1, -2, 0.375), (2, -2, 0.125), (1, -1, 0.375), (2, -1, 0.125), (0, 0, -0.5), (0, 1, -1.5), (-1, 1, 1)], "repeat", DOUBLES, _WEIGHED),
)
_add("i2_bordered_subview", lambda s, d: stencil.bordered(i.embq(s, d), Region((10, 50), (20, 30)), (1, 1), (1, 1), lambda g: stencil.convolve(g, _FULL)), _conv_sql(_taps(_FULL)).replace("SELECT a.x, a.y,", "SELECT a.x - 10 AS x, a.y - 50 AS y,").replace(" GROUP BY", " WHERE a.x BETWEEN 10 AND 29 AND a.y BETWEEN 50 AND 79 GROUP BY"))
_SOBEL = "WITH {image}, {count}, t(dx, dy, wx, wy) AS (VALUES (-1,-1,1,1), (0,-1,0,2), (1,-1,-1,1), (-1,0,2,0), (1,0,-2,0), (-1,1,1,-1), (0,1,0,-2), (1,1,-1,-1)), g AS (SELECT a.x, a.y, sum(b.v * t.wx) AS gx, sum(b.v * t.wy) AS gy FROM img a CROSS JOIN t JOIN img b ON b.x = {bx} AND b.y = {by} GROUP BY a.x, a.y)".format(image=IMAGE, count=COUNT, bx=_place("a.x", "t.dx", "64", "repeat"), by=_place("a.y", "t.dy", "(SELECT n FROM n)", "repeat"))


def _energy(s, d):
    gx, gy = stencil.convolve_all(i.embq(s, d), [k.sobel(2, 0), k.sobel(2, 1)])
    edge = e.threshold(e.square(gx) + e.square(gy), 1_000_000, 1, 0)
    strong = (e.square(gx) + e.square(gy)) * edge
    return r.dimension_reduce(strong, 0, "sum").cells.select(F.col("x").alias("y"), F.col("v").alias("energy"))


_add(FLAGSHIP, _energy, _SOBEL + " SELECT y, CAST(sum(CASE WHEN gx*gx + gy*gy > 1000000 THEN gx*gx + gy*gy ELSE 0 END) AS BIGINT) AS energy FROM g GROUP BY y")
_add("n16_sobel_edges", lambda s, d: millionths(stencil.edges(i.embq(s, d))), _SOBEL + f" SELECT x, y, {_mq('CASE WHEN least(3 * sqrt(CAST(gx*gx + gy*gy AS DOUBLE)), 255) < 50 THEN 0 ELSE least(3 * sqrt(CAST(gx*gx + gy*gy AS DOUBLE)), 255) END')} AS v FROM g")
_add("n17_edge_detection", lambda s, d: (lambda p: e.threshold(e.square_root(e.square(p[0]) + e.square(p[1])), 1270, 255, 0))(stencil.convolve_all(i.embq(s, d), [k.sobel(2, 0), k.sobel(2, 1)])), _SOBEL + " SELECT x, y, CASE WHEN sqrt(CAST(gx*gx + gy*gy AS DOUBLE)) > 1270 THEN 255 ELSE 0 END AS v FROM g")


def _laplace_sql(rounds: int) -> str:
    out, last = f"WITH {IMAGE}, {COUNT}, t(dx, dy, w) AS (VALUES (0,-1,1), (-1,0,1), (0,0,-4), (1,0,1), (0,1,1))", "img"
    for p in range(rounds):
        out += f", p{p} AS (SELECT a.x, a.y, CAST(sum(b.v * t.w) AS BIGINT) AS v FROM {last} a CROSS JOIN t JOIN {last} b ON b.x = {_place('a.x', 't.dx', '64', 'repeat')} AND b.y = {_place('a.y', 't.dy', '(SELECT n FROM n)', 'repeat')} GROUP BY a.x, a.y)"
        last = f"p{p}"
    return out + f" SELECT x, y, v FROM {last}"


_add("n19_laplace_many_rounds", lambda s, d: iterative.laplace_iteration(i.embq(s, d), 12), _laplace_sql(12))
_add("n19_laplace_iteration", lambda s, d: iterative.laplace_iteration(i.embq(s, d), 3), _laplace_sql(3))


def _pass(name: str, source: str, taps: str, value: str, more: str = "") -> str:
    """A gather of one round as a common table expression."""
    return f", {name} AS (SELECT a.x, a.y, {value} AS v FROM {source} a CROSS JOIN {taps} t JOIN {more or source} b ON b.x = {_place('a.x', 't.dx', '64', 'repeat')} AND b.y = {_place('a.y', 't.dy', '(SELECT n FROM n)', 'repeat')} GROUP BY a.x, a.y, a.v)"


_DIFFUSE = "a.v + sum(exp(-((b.v - a.v) / 1.5) * ((b.v - a.v) / 1.5)) * (b.v - a.v) * 0.2e0)"
_add("n20_anisotropic_diffusion", lambda s, d: millionths(iterative.anisotropic_diffusion(i.emb(s, d), 2, 1.5, 0.2)), f"WITH {DOUBLES}, {COUNT}, t(dx, dy) AS (VALUES (0,-1), (-1,0), (1,0), (0,1))" + _pass("p", "img", "t", _DIFFUSE) + _pass("q", "p", "t", _DIFFUSE) + f" SELECT x, y, {_mq('v')} AS v FROM q")


def _lucy_sql(kernel: k.Kernel, rounds: int) -> str:
    rows = ", ".join(f"({x}, {y}, CAST('{w!r}' AS DOUBLE))" for x, y, w in _taps(kernel))
    back = ", ".join(f"({x}, {y}, CAST('{w!r}' AS DOUBLE))" for x, y, w in _taps(kernel.flipped()))
    out = f"WITH {DOUBLES.replace('CAST(e.embedding[i] AS DOUBLE)', '0.5e0 + abs(CAST(e.embedding[i] AS DOUBLE))')}, {COUNT}, t(dx, dy, w) AS (VALUES {rows}), u(dx, dy, w) AS (VALUES {back})"
    last = "img"
    for p in range(rounds):
        out += _pass(f"s{p}", last, "t", "sum(b.v * t.w)")
        out += f", r{p} AS (SELECT d.x, d.y, d.v / s.v AS v FROM img d JOIN s{p} s USING (x, y))" + _pass(f"b{p}", f"r{p}", "u", "sum(b.v * t.w)")
        out += f", e{p} AS (SELECT e.x, e.y, e.v * b.v AS v FROM {last} e JOIN b{p} b USING (x, y))"
        last = f"e{p}"
    return out + f" SELECT x, y, {_mq('v')} AS v FROM {last}"


_add("n18_richardson_lucy", lambda s, d: millionths(iterative.richardson_lucy(e.add_value(e.absolute(i.emb(s, d)), 0.5), k.gaussian_nd(0.7, 0.7), 2)), _lucy_sql(k.gaussian_nd(0.7, 0.7), 2))

# --- reductions ----------------------------------------------------------------------------------------------------

_add("r1_reduce_max_initial", lambda s, d: r.reduce(i.embq(s, d), "max", 123456), f"WITH {IMAGE} SELECT greatest(max(v), 123456) AS v FROM img")
_add("r3_reduce_x", lambda s, d: r.dimension_reduce(i.embq(s, d), 0, "sum"), f"WITH {IMAGE} SELECT y AS x, CAST(sum(v) AS BIGINT) AS v FROM img GROUP BY y")
_add("r3_reduce_y", lambda s, d: r.dimension_reduce(i.embq(s, d), 1, "min"), f"WITH {IMAGE} SELECT x, min(v) AS v FROM img GROUP BY x")
_add("r3_reduce_volume_y", lambda s, d: r.dimension_reduce(i.shipped(s, d), 1, "sum", 1000), f"WITH {SHIPPED} SELECT x, z AS y, CAST(1000 + sum(v) AS BIGINT) AS v FROM img GROUP BY x, z")


def _last_multiple(a: np.ndarray, axis: int) -> np.ndarray:
    """The last of the cells that isn't zero."""
    turned = np.moveaxis(a, axis, -1)[..., ::-1]
    return np.take_along_axis(turned, (turned != 0).argmax(-1)[..., None], -1)[..., 0]


_add("r3_reduce_gcd", lambda s, d: (lambda g: r.reduce_along(g.with_value(g.value - F.pmod(g.value, F.lit(6))), 1, np.gcd.reduce))(i.embq(s, d)), f"WITH {IMAGE} SELECT x, CAST(list_reduce(list(v - ((v % 6) + 6) % 6), lambda a, b: gcd(a, b)) AS BIGINT) AS v FROM img GROUP BY x")
_add("r3_last_multiple", lambda s, d: (lambda g: r.reduce_along(g.with_value(F.when(g.value % 7 == 0, g.value).otherwise(F.lit(0).cast("bigint"))), 1, _last_multiple, 4_000))(i.embq(s, d)), f"WITH {IMAGE} SELECT x, coalesce(max_by(v, y) FILTER (WHERE v % 7 = 0 AND v <> 0), 0) AS v FROM img GROUP BY x")
_add("r5_sum", lambda s, d: r.total(i.embq(s, d)), f"WITH {IMAGE} SELECT CAST(sum(v) AS BIGINT) AS v FROM img")
_add("r6_sum_square_differences", lambda s, d: (lambda g: combine.sum_square_differences(g, index_space.mirrored(g, (True, False))))(i.embq(s, d)), f"WITH {IMAGE} SELECT CAST(sum((a.v - b.v) * (a.v - b.v)) AS BIGINT) AS v FROM img a JOIN img b ON b.y = a.y AND b.x = 63 - a.x")
_add("r7_min_max", lambda s, d: r.min_max(i.embq(s, d)), f"WITH {IMAGE} SELECT min(v) AS min, max(v) AS max FROM img")
_add("r8_min_max_mean", lambda s, d: r.min_max_mean(i.embq(s, d)), f"WITH {IMAGE} SELECT min(v) AS min, max(v) AS max, CAST(sum(v) AS DOUBLE) / count(*) AS mean FROM img")
_add("r9_all_finite", lambda s, d: r.all_finite(i.emb(s, d)), f"WITH {DOUBLES} SELECT bool_and(isfinite(v)) AS v FROM img")
_add("r10_bit_xor", lambda s, d: r.reduce(i.embq(s, d), "bit_xor"), f"WITH {IMAGE} SELECT bit_xor(v) AS v FROM img")
_add("r11_max_intensity_z", lambda s, d: r.max_intensity(i.shipped(s, d), 2), f"WITH {SHIPPED} SELECT x, y, max(v) AS v FROM img GROUP BY x, y")
_add("r12_arg_max", lambda s, d: r.arg_max(i.embq(s, d)), f"WITH {IMAGE} SELECT x, y, v FROM img ORDER BY v DESC, x + 64 * y LIMIT 1")
_add("r12_arg_max_inside", lambda s, d: r.arg_max(i.embq(s, d), True), f"WITH {IMAGE} SELECT x, y, v FROM img WHERE x > 0 AND y > 0 ORDER BY v DESC, x + 64 * y LIMIT 1")
_add("r13_vector_sum", lambda s, d: r.vector_reduce(Grid(i.vectors(s, d).select(F.col("vec_id").alias("x"), "a"), (i.height(s, d),), F.col("a")), 3, "sum").select(*(F.col("v")[j].alias(f"v{j}") for j in range(3))), f"WITH {VECTORS} SELECT " + ", ".join(f"CAST(sum(a[{j + 1}]) AS BIGINT) AS v{j}" for j in range(3)) + " FROM vec")
_add("m9_custom_reduction", lambda s, d: r.reduce_by(i.embq(s, d), lambda v: int((v % 7).sum()), lambda v: int(v.sum()), "bigint"), f"WITH {IMAGE} SELECT CAST(sum(((v % 7) + 7) % 7) AS BIGINT) AS v FROM img")
_add("m8_by_batches", lambda s, d: e.by_batches(i.embq(s, d), lambda v: v * v % 1009, "bigint"), _img("v * v % 1009"))
_add("m1_for_each", lambda s, d: e.for_each(i.embq(s, d), lambda v: v * 2 - 1), _img("v * 2 - 1"))
_add("m4_transform_bench", lambda s, d: millionths(e.for_each(i.emb(s, d), lambda v: F.log(2 + F.sin(v)))), _img(_mq("ln(2 + sin(v))"), DOUBLES))
_add("m5_transform_position", lambda s, d: e.transform_position(i.shipped(s, d), lambda v, x, y, z: v + x - y * z), f"WITH {SHIPPED} SELECT x, y, z, v + x - y * z AS v FROM img")

# --- interpolation and geometry ------------------------------------------------------------------------------------


def _linear_sql(px: str, py: str, size: tuple[str, str], border: str = "repeat") -> str:
    bx, by = _place("fx", "ox", "64", border), _place("fy", "oy", "(SELECT n FROM n)", border)
    return (
        f"WITH {DOUBLES}, {COUNT}, g AS (SELECT a.x, b.y FROM (SELECT unnest(range({size[0]})) AS x FROM n) a CROSS JOIN (SELECT unnest(range({size[1]})) AS y FROM n) b), "
        f"p AS (SELECT x, y, {px} AS px, {py} AS py FROM g), f AS (SELECT *, CAST(floor(px) AS BIGINT) AS fx, CAST(floor(py) AS BIGINT) AS fy FROM p), o(ox, oy) AS (VALUES (0,0),(1,0),(0,1),(1,1)) "
        f"SELECT f.x, f.y, CAST(floor(sum(coalesce(i.v, 0) * (CASE WHEN ox = 1 THEN px - fx ELSE 1 - (px - fx) END) * (CASE WHEN oy = 1 THEN py - fy ELSE 1 - (py - fy) END)) * 1e6 + 0.5) AS BIGINT) AS v FROM f CROSS JOIN o LEFT JOIN img i ON i.x = {bx} AND i.y = {by} GROUP BY f.x, f.y"
    )


_add("x2_nearest", lambda s, d: interpolate.resampled(i.embq(s, d), (100, i.height(s, d)), lambda at: [at[0] * 0.6 + 0.2, at[1] * 1.7 + 0.4], "nearest"), f"WITH {IMAGE}, {COUNT}, g AS (SELECT a.x, b.y, CAST(round(a.x * 0.6e0 + 0.2e0 - 0.499999e0) AS BIGINT) AS sx, CAST(round(b.y * 1.7e0 + 0.4e0 - 0.499999e0) AS BIGINT) AS sy FROM range(100) a(x) CROSS JOIN (SELECT unnest(range(n)) AS y FROM n) b) SELECT g.x, g.y, i.v FROM g, n JOIN img i ON i.x = greatest(0, least(63, g.sx)) AND i.y = greatest(0, least(n.n - 1, g.sy))")
_add("x3_linear", lambda s, d: millionths(interpolate.resampled(i.emb(s, d), (100, i.height(s, d)), lambda at: [at[0] * 0.625 + 0.25, at[1] * 1.5 + 0.125])), _linear_sql("x * 0.625e0 + 0.25e0", "y * 1.5e0 + 0.125e0", ("100", "n")))


def _cubic_axis(name: str, p: str, size: str, limit: str) -> str:
    """Taps of one axis: four of every target, by the two-read form."""
    return (
        f"{name}p AS (SELECT i, {p} AS p FROM (SELECT unnest(range({size})) AS i FROM n)), {name}w AS (SELECT i, floor(p) AS low, p - floor(p) AS t FROM {name}p), "
        f"{name}g AS (SELECT i, low, -0.5e0*t + t*t - 0.5e0*t*t*t AS w0, 1 - 2.5e0*t*t + 1.5e0*t*t*t AS w1, 0.5e0*t + 2e0*t*t - 1.5e0*t*t*t AS w2, -0.5e0*t*t + 0.5e0*t*t*t AS w3 FROM {name}w), "
        f"{name}r AS (SELECT i, w0 + w1 AS g, low - 1 + w1 / (w0 + w1) AS pos FROM {name}g UNION ALL SELECT i, w2 + w3, low + 1 + CASE WHEN w2 + w3 = 0 THEN 0 ELSE w3 / (w2 + w3) END FROM {name}g), "
        f"{name}t AS (SELECT i, greatest(0, least({limit} - 1, CAST(floor(pos) AS BIGINT) + o)) AS c, g * CASE WHEN o = 1 THEN pos - floor(pos) ELSE 1 - (pos - floor(pos)) END AS w FROM {name}r, (VALUES (0), (1)) o(o))"
    )


_add("x4_cubic", lambda s, d: millionths(interpolate.resampled(i.emb(s, d), (100, i.height(s, d)), lambda at: [at[0] * 0.625 + 0.25, at[1] * 1.5 + 0.125], "cubic")), f"WITH {DOUBLES}, {COUNT}, {_cubic_axis('x', 'i * 0.625e0 + 0.25e0', '100', '64')}, {_cubic_axis('y', 'i * 1.5e0 + 0.125e0', 'n', '(SELECT n FROM n)')} SELECT xt.i AS x, yt.i AS y, {_mq('sum(img.v * xt.w * yt.w)')} AS v FROM xt CROSS JOIN yt JOIN img ON img.x = xt.c AND img.y = yt.c GROUP BY xt.i, yt.i")
for _name, (_how, _border) in interpolate.PRESETS.items():
    if _how != "cubic":
        _p = ("x * 0.5e0 - 3.25e0", "y * 1.25e0 + 0.5e0")
        _add(f"x6_{_name}", lambda s, d, h=_how, b=_border: millionths(interpolate.resampled(i.emb(s, d), (90, i.height(s, d)), lambda at: [at[0] * 0.5 - 3.25, at[1] * 1.25 + 0.5], h, b)), _linear_sql(*(_p if _how == "linear" else (f"round({q} - 0.499999e0)" for q in _p)), ("90", "n")))
_add("x5_lerp", lambda s, d: (lambda g: millionths(combine.n_ary(lambda a, b: interpolate.lerp(a, b, F.lit(0.3)), g, index_space.mirrored(g, (True, False)))))(i.emb(s, d)), f"WITH {DOUBLES} SELECT a.x, a.y, {_mq('0.7e0 * a.v + 0.3e0 * b.v')} AS v FROM img a JOIN img b ON b.y = a.y AND b.x = 63 - a.x")
_add(
    "m10_user_border_and_taps",
    lambda s, d: interpolate.resampled(
        i.embq(s, d), (70, i.height(s, d)), lambda at: [at[0] - 3, at[1]],
        lambda q: [(F.floor(q).cast("bigint"), F.lit(2.0))], lambda c, n: F.when(c < 0, n - 1).when(c < n, c),
    ),
    f"""WITH {IMAGE}, {COUNT}, g AS (SELECT a.x, b.y, CASE WHEN a.x < 3 THEN 63 ELSE a.x - 3 END AS sx FROM range(70) a(x) CROSS JOIN (SELECT unnest(range(n)) AS y FROM n) b)
    SELECT g.x, g.y, CAST(4 * coalesce(img.v, 0) AS BIGINT) AS v FROM g LEFT JOIN img ON img.x = g.sx AND img.y = g.y""",
)
_add("x7_texture", lambda s, d: millionths(interpolate.texture(i.emb(s, d), (80, i.height(s, d)), lambda at: [at[0] - 4.5, at[1] - 3.25])), _linear_sql("x - 4.5e0", "y - 3.25e0", ("80", "n"), "outside"))
_add("x10_geometry_identity", lambda s, d: millionths(interpolate.geometry_transformation(i.emb(s, d), (64, i.height(s, d)), lambda at: at)), _linear_sql("x + 0.5e0", "y + 0.5e0", ("64", "n")))
_add("x10_geometry_centred", lambda s, d: millionths(interpolate.geometry_transformation(i.emb(s, d), (64, i.height(s, d)), lambda at: at, centred=True)), _img(_mq("v"), DOUBLES))
_add("x11_scale", lambda s, d: millionths(interpolate.scaled(i.emb(s, d), (2.0, 0.5), (128, i.height(s, d) // 2), (8.0, 4.0))), _linear_sql("8 + (x + 0.5e0 - 8) / 2", "4 + (y + 0.5e0 - 4) / 0.5e0", ("128", "n // 2")))
_add("x8_rotate_quarter", lambda s, d: (lambda g: g.with_value(F.round(g.value * 4).cast("bigint")))(interpolate.rotated((lambda v: v.with_value(v.value.cast("double")))(i.shipped(s, d)), interpolate.rotation_about((0, 0, 1), interpolate.degrees(90)), (3.5, 6.0, 3.5))), f"WITH {SHIPPED} SELECT t.x, t.y, t.z, CAST(sum(coalesce(s.v, 0)) AS BIGINT) AS v FROM img t CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(ox, oy) LEFT JOIN img s ON s.x = CAST(floor(t.y + 0.5 - 6 + 3.5 - 0.5) AS BIGINT) + o.ox AND s.y = CAST(floor(-(t.x + 0.5 - 3.5) + 6 - 0.5) AS BIGINT) + o.oy AND s.z = t.z GROUP BY ALL")

_STEPS = render.table_transfer((0.113, 0.317, 0.631, 0.977), (0.0, 0.131, 0.317, 0.523), 0.0, 4000.0)
_ENTRY = "greatest(0, least(3, CAST(floor(v / 4000.0 * 4) AS BIGINT))) + 1"
_add("x12_composited_rays", lambda s, d: millionths(render.composited((lambda g: g.with_value(F.struct(*(c.alias(n) for c, n in zip(_STEPS(g.value), "ca")))))(i.shipped(s, d)))), f"WITH {SHIPPED}, p AS (SELECT x, y, z, [0.113e0, 0.317e0, 0.631e0, 0.977e0][{_ENTRY}] AS c, [0.0e0, 0.131e0, 0.317e0, 0.523e0][{_ENTRY}] AS a FROM img), q AS (SELECT x, y, c * a * exp(coalesce(sum(ln(1 - a)) OVER (PARTITION BY x, y ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS w FROM p) SELECT x, y, {_mq('sum(w)')} AS v FROM q GROUP BY x, y")
_add(
    "x12_ray_cast",
    lambda s, d: millionths(render.ray_cast(i.shipped(s, d), _STEPS)),
    f"""WITH {SHIPPED},
    g AS (SELECT x, y, z, v,
      0.5e0 * (lead(v, 1, v) OVER (PARTITION BY y, z ORDER BY x) - lag(v, 1, v) OVER (PARTITION BY y, z ORDER BY x)) AS gx,
      0.5e0 * (lead(v, 1, v) OVER (PARTITION BY x, z ORDER BY y) - lag(v, 1, v) OVER (PARTITION BY x, z ORDER BY y)) AS gy,
      0.5e0 * (lead(v, 1, v) OVER (PARTITION BY x, y ORDER BY z) - lag(v, 1, v) OVER (PARTITION BY x, y ORDER BY z)) AS gz
      FROM img),
    n AS (SELECT x, y, z, v, greatest(-gz / CASE WHEN sqrt(gx*gx + gy*gy + gz*gz) < 1e-9 THEN 1e0 ELSE sqrt(gx*gx + gy*gy + gz*gz) END, 0e0) AS t FROM g),
    p AS (SELECT x, y, z, [0.113e0, 0.317e0, 0.631e0, 0.977e0][{_ENTRY}] * (0.3e0 + 0.7e0 * t) + 0.2e0 * pow(t, 8) AS c, [0.0e0, 0.131e0, 0.317e0, 0.523e0][{_ENTRY}] AS a FROM n),
    q AS (SELECT x, y, c * a * exp(coalesce(sum(ln(1 - a)) OVER (PARTITION BY x, y ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS w FROM p)
    SELECT x, y, {_mq('sum(w)')} AS v FROM q GROUP BY x, y""",
)

_VIEW = render.Camera(corner=(-3.0, -2.0, -4.0), across=(0.5, 0.0, 0.25), down=(0.0, 0.75, 0.0), direction=(0.5, 0.25, 1.0))
_RAYS = (24, 20, 80)


def _colours(v):
    return [v / 4000, 1 - v / 4000, F.sqrt(F.abs(v)) / 100], F.least(v / 40000, F.lit(0.9))


def _eyed(camera: render.Camera, channels: Sequence[str] = ("v / 4000", "1 - v / 4000", "sqrt(abs(v)) / 100"), opacity: str = "least(v / 40000, 0.9e0)") -> str:
    """Samples of all rays, eight cells each, blended by running products of what each lets through."""
    at = [f"({c}e0 + x * {a}e0 + y * {b}e0)" for c, a, b in zip(camera.corner, camera.across, camera.down)]
    away = [f"({p} - {e}e0)" for p, e in zip(at, camera.eye)] if camera.eye else [f"{d}e0" for d in camera.direction]
    size = "sqrt(" + " + ".join(f"{a} * {a}" for a in away) + ")"
    position = ", ".join(f"{p} + z * 0.25e0 * ({a} / {size}) AS p{c}" for p, a, c in zip(at, away, "xyz"))
    inside = " AND ".join(f"p{c} >= 0 AND p{c} <= {n - 1}" for c, n in zip("xyz", (7, 12, 7)))
    weight = " * ".join(f"CASE WHEN o{c} = 1 THEN p{c} - floor(p{c}) ELSE 1 - (p{c} - floor(p{c})) END" for c in "xyz")
    cells = " AND ".join(f"g.{c} = CAST(floor(p.p{c}) AS BIGINT) + o{c}" for c in "xyz")
    names = [f"c{i}" for i in range(len(channels))]
    return f"""WITH {SHIPPED}, r AS (SELECT a.x, b.y, c.z FROM range({_RAYS[0]}) a(x) CROSS JOIN range({_RAYS[1]}) b(y) CROSS JOIN range({_RAYS[2]}) c(z)),
    p AS (SELECT * FROM (SELECT x, y, z, {position} FROM r) WHERE {inside}),
    s AS (SELECT p.x, p.y, p.z, sum(coalesce(g.v, 0) * {weight}) AS v FROM p CROSS JOIN (SELECT a.o AS ox, b.o AS oy, c.o AS oz FROM range(2) a(o) CROSS JOIN range(2) b(o) CROSS JOIN range(2) c(o)) LEFT JOIN img g ON {cells} GROUP BY p.x, p.y, p.z),
    t AS (SELECT x, y, {', '.join(f'{c} AS {n}' for c, n in zip(channels, names))}, {opacity} AS a, exp(coalesce(sum(ln(1 - {opacity})) OVER (PARTITION BY x, y ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS l FROM s),
    u AS (SELECT x, y, {', '.join(f'sum({n} * a * l) AS {n}' for n in names)}, exp(sum(ln(1 - a))) AS light FROM t GROUP BY x, y)
    SELECT q.x, q.y, {', '.join(f"{_mq(f'coalesce({n}, 0)')} AS {n}" for n in names)}, {_mq('coalesce(light, 1)')} AS light FROM (SELECT DISTINCT x, y FROM r) q LEFT JOIN u USING (x, y)"""


def _seen(s, d, camera):
    img = render.viewed(i.shipped(s, d), camera, _RAYS[:2], _RAYS[2], 0.25, _colours)
    whole = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("bigint")
    return img.select("x", "y", *(whole(c).alias(c) for c in ("c0", "c1", "c2")), whole("left").alias("light"))


_EYE = render.Camera(corner=(-2.0, 1.0, -3.0), across=(0.5, 0.0, 0.0), down=(0.0, 0.5, 0.125), eye=(3.25, 5.5, -14.0))
_add("x12_view_along_a_slant", lambda s, d: _seen(s, d, _VIEW), _eyed(_VIEW))
_add("x12_view_from_a_point", lambda s, d: _seen(s, d, _EYE), _eyed(_EYE))

# --- frequency domain ----------------------------------------------------------------------------------------------

_DFT = f"WITH {DOUBLES}, f AS (SELECT k.x AS x, img.y AS y, sum(img.v * cos(2 * pi() * k.x * img.x / 64)) AS re, -sum(img.v * sin(2 * pi() * k.x * img.x / 64)) AS im FROM img CROSS JOIN range(33) k(x) GROUP BY k.x, img.y)"


def _parts(g: Grid) -> DataFrame:
    q = lambda c: F.floor(c * 1e4 + 0.5).cast("bigint")
    return g.df.select(*g.dims, q(g.value["re"]).alias("re"), q(g.value["im"]).alias("im"))


def _tq(x: str) -> str:
    return f"CAST(floor(({x}) * 1e4 + 0.5) AS BIGINT)"


def _long_round_trip(s, d):
    """The image's rows as one signal, through a split transform and back."""
    g, n = i.emb(s, d), 64 * i.height(s, d)
    signal = Grid(g.settled().df.select((F.col("x") + 64 * F.col("y")).alias("x"), "v"), (n,))
    back = millionths(singles(fourier.inverse_normalized(fourier.forward(signal), n)))
    return back.settled().df.select((F.col("x") % 64).alias("x"), F.expr("x div 64").alias("y"), "v")




def _padded_signal(s, d, n):
    """The image's rows as one signal, with zeros up to ``n`` cells."""
    g = i.emb(s, d)
    held = g.settled().df.select((F.col("x") + 64 * F.col("y")).alias("x"), "v")
    rest = s.range(64 * g.size[1], n).select(F.col("id").alias("x"), F.lit(0.0).alias("v"))
    return Grid(held.unionByName(rest), (n,))


def _prime(n: int) -> int:
    while any(n % p == 0 for p in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def _prime_round_trip(s, d):
    """A signal of a prime number of cells through a transform by chirps and back."""
    n = _prime(64 * i.height(s, d))
    back = millionths(singles(fourier.inverse_normalized(fourier.forward(_padded_signal(s, d, n)), n))).settled().df
    return back.select((F.col("x") % 64).alias("x"), F.expr("x div 64").alias("y"), "v")


def _tall_round_trip(s, d):
    """The image in eight columns through a transform of both axes, the tall one split, and back."""
    n = 8 * i.height(s, d)
    g = millionths(singles(fourier.inverse_normalized(fourier.forward(index_space.reshaped(i.emb(s, d), (8, n))), 8)))
    at = F.col("x") + 8 * F.col("y")
    return g.settled().df.select((at % 64).alias("x"), F.expr("(x + 8 * y) div 64").alias("y"), "v")


_add("f1_tall_round_trip", _tall_round_trip, _img(_mq("v"), DOUBLES))
_add("f1_prime_length_round_trip", _prime_round_trip, f"WITH {DOUBLES}, {COUNT} SELECT x, y, {_mq('v')} AS v FROM img UNION ALL SELECT k % 64 AS x, k // 64 AS y, CAST(0 AS BIGINT) AS v FROM (SELECT unnest(range(64 * n, p)) AS k FROM (SELECT n, (SELECT min(64 * n + c) FROM range(1000) r(c) WHERE NOT EXISTS (SELECT 1 FROM range(2, 100000) q(f) WHERE f * f <= 64 * n + c AND (64 * n + c) % f = 0)) AS p FROM n))")
_add(
    "f1_column_transform",
    lambda s, d: _parts(fourier.forward(i.emb(s, d), stack=(0,))),
    f"""WITH {DOUBLES}, {COUNT} SELECT img.x, k.y, {_tq('sum(img.v * cos(2 * pi() * ((k.y * img.y) % n) / n))')} AS re, {_tq('-sum(img.v * sin(2 * pi() * ((k.y * img.y) % n) / n))')} AS im
    FROM img, n, (SELECT unnest(range(n // 2 + 1)) AS y FROM n) k GROUP BY img.x, k.y""",
)
_add("f1_row_transform", lambda s, d: _parts(fourier.forward(i.emb(s, d), stack=(1,))), f"{_DFT} SELECT x, y, {_tq('re')} AS re, {_tq('im')} AS im FROM f")
_add("f1_round_trip", lambda s, d: (lambda g: millionths(singles(fourier.inverse_normalized(fourier.forward(g), g.size[0]))))(i.emb(s, d)), _img(_mq("v"), DOUBLES))
_add("f1_long_signal_round_trip", _long_round_trip, _img(_mq("v"), DOUBLES))
_add("f3_stack_normalized", lambda s, d: _parts(fourier.forward_normalized(i.emb(s, d), stack=(1,))), f"{_DFT} SELECT x, y, {_tq('re / 64')} AS re, {_tq('im / 64')} AS im FROM f")
_add("u17_power_spectrum", lambda s, d: (lambda g: g.with_value(F.floor(g.value * 1e3 + 0.5).cast("bigint")))(complexes.amplitude(fourier.forward(i.emb(s, d), stack=(1,)))), f"{_DFT} SELECT x, y, CAST(floor((re*re + im*im) * 1e3 + 0.5) AS BIGINT) AS v FROM f")
_add("i8_half_spectrum", lambda s, d: _parts(index_space.centred_half(fourier.forward(i.emb(s, d), stack=(1,)))), f"{_DFT}, {COUNT} SELECT x, CASE WHEN y >= n.n - (n.n - 1) // 2 THEN y - n.n ELSE y END AS y, {_tq('re')} AS re, {_tq('im')} AS im FROM f, n")
_add(
    "i9_full_spectrum",
    lambda s, d: _parts(index_space.full_spectrum(fourier.forward(i.emb(s, d)))),
    f"""{_DFT}, {COUNT},
    h AS (SELECT f.x, k.y, sum(f.re * cos(2 * pi() * k.y * f.y / n) + f.im * sin(2 * pi() * k.y * f.y / n)) AS re,
      sum(f.im * cos(2 * pi() * k.y * f.y / n) - f.re * sin(2 * pi() * k.y * f.y / n)) AS im
      FROM f, n, (SELECT unnest(range(n)) AS y FROM n) k GROUP BY f.x, k.y),
    e AS (SELECT x, y, re, im FROM h, n WHERE y <= n // 2 UNION ALL SELECT x, y - n AS y, re, im FROM h, n WHERE y - n >= -(n // 2))
    SELECT x + 32 AS x, y + n // 2 AS y, {_tq('re')} AS re, {_tq('im')} AS im FROM e, n
    UNION ALL SELECT 32 - x AS x, n // 2 - y AS y, {_tq('re')} AS re, {_tq('-im')} AS im FROM e, n WHERE x > 0""",
)


def _correlation(s, d):
    g = i.emb(s, d).settled()
    moved = index_space.padded(g, g.size, (5, 9), 0.0)
    peak = r.arg_max(fourier.phase_correlation(moved, g))
    return peak.select("x", "y")


_add("f4_phase_correlation_peak", _correlation, "SELECT CAST(5 AS BIGINT) AS x, CAST(9 AS BIGINT) AS y")


def _wiener(s, d):
    g = i.emb(s, d).settled()
    spread = index_space.padded(tables.from_array(s, k.gaussian_nd(0.6, 0.6).weights.tolist()), g.size, (-1, -1), 0.0)
    blurred = fourier.convolved_by_spectrum(g, spread).settled()
    return millionths(singles(fourier.wiener_deconvolution(blurred, spread, 1e-12)).settled().with_value(F.round(F.col("v"), 4)))


_add("f5_wiener", _wiener, _img(_mq("round(v, 4)"), DOUBLES))

# --- vectors, complex numbers, quaternions, matrices ---------------------------------------------------------------


def _vec(name: str, spark_value: Callable[[F.Column, F.Column], F.Column], sql: str) -> None:
    _add(name, lambda s, d: i.vectors(s, d).select("vec_id", spark_value(F.col("a"), F.col("b")).alias("v")), f"WITH {VECTORS} SELECT vec_id, {sql} AS v FROM vec")


_sum = lambda x: f"CAST(list_sum({x}) AS BIGINT)"
_two = lambda x: f"list_transform(list_zip(a, b), lambda p: {x})"
_vec("v2_less_equal", vectors.less_equal, f"list_bool_and({_two('p[1] <= p[2]')})")
_vec("v3_add", lambda a, b: vectors.total(vectors.add(a, vectors.negated(b))), _sum(_two("p[1] - p[2]")))
_vec("v3_scaled", lambda a, b: vectors.total(vectors.scaled(a, 3)), _sum("list_transform(a, lambda p: p * 3)"))
_vec("v4_max_min", lambda a, b: vectors.total(vectors.maximum(a, b)) * 2 - vectors.total(vectors.minimum(a, b)), f"{_sum(_two('greatest(p[1], p[2])'))} * 2 - {_sum(_two('least(p[1], p[2])'))}")
_vec("v4_mod_periodic", lambda a, b: vectors.total(vectors.modulo_periodic(a, F.array_repeat(F.lit(7), 32))), _sum("list_transform(a, lambda p: ((p % 7) + 7) % 7)"))
_vec("v4_divide", lambda a, b: vectors.total(vectors.divide(a, F.array_repeat(F.lit(7).cast("bigint"), 32))), _sum("list_transform(a, lambda p: CAST(trunc(p / 7) AS BIGINT))"))
_vec("v5_dot", vectors.dot, _sum(_two("p[1] * p[2]")))
_vec("v5_sum", lambda a, b: vectors.total(a), _sum("a"))
_vec("v5_min_max_element", lambda a, b: vectors.max_element(a) - vectors.min_element(b), "list_max(a) - list_min(b)")
_vec("v5_find", lambda a, b: vectors.find(a, a[4]), "CAST(list_position(a, a[5]) - 1 AS BIGINT)")
_vec("v6_min_above", lambda a, b: vectors.min_element_above(a, 100, 99999), "coalesce(list_min(list_filter(a, lambda p: p > 100)), 99999)")
_vec("v6_max_below", lambda a, b: vectors.max_element_below(a, -100, -99999), "coalesce(list_max(list_filter(a, lambda p: p < -100)), -99999)")
_vec("v7_norm", lambda a, b: vectors.norm(a), "sqrt(CAST(list_sum(list_transform(a, lambda p: p * p)) AS DOUBLE))")
_vec("v7_cross", lambda a, b: (lambda c: c[0] + 2 * c[1] + 3 * c[2])(vectors.cross(a, b)), "(a[2]*b[3] - a[3]*b[2]) + 2 * (a[3]*b[1] - a[1]*b[3]) + 3 * (a[1]*b[2] - a[2]*b[1])")
_vec("v8_clamp", lambda a, b: vectors.total(vectors.clamp(a, F.array_repeat(F.lit(-50).cast("bigint"), 32), F.array_repeat(F.lit(80).cast("bigint"), 32))), _sum("list_transform(a, lambda p: least(greatest(p, -50), 80))"))
_vec("v1_cube_signum", lambda a, b: vectors.total(vectors.cubed(a)) + vectors.total(vectors.signum(b)).cast("bigint"), f"{_sum('list_transform(a, lambda p: p * p * p)')} + {_sum('list_transform(b, lambda p: CAST(sign(p) AS BIGINT))')}")
_vec("v1_power", lambda a, b: vectors.total(vectors.power(a, 4)), _sum("list_transform(a, lambda p: p * p * p * p)"))
_vec("v9_insert_remove", lambda a, b: vectors.dot(vectors.remove_dimension(vectors.insert_dimension(a, 5, F.lit(7).cast("bigint")), 0), b), "CAST(list_sum([b[j] * CASE WHEN j < 5 THEN a[j + 1] WHEN j = 5 THEN 7 ELSE a[j] END for j in range(1, 33)]) AS BIGINT)")
_vec("v9_swizzle", lambda a, b: (lambda c: c[0] * 100 + c[1] * 10 + c[2])(vectors.swizzle(a, (2, 1, 0))), "a[3] * 100 + a[2] * 10 + a[1]")
_turn = Quaternion.rotation(0.5, (1, 2, 3))
_rot = _turn.matrix()
_vec("v10_rotate", lambda a, b: F.floor(sum(c * (j + 1) for j, c in enumerate(rotate_columns(_turn, [a[0].cast("double"), a[1].cast("double"), a[2].cast("double")])))).cast("bigint"), "CAST(floor(" + " + ".join(f"(a[1] * CAST('{_rot[q][0]!r}' AS DOUBLE) + a[2] * CAST('{_rot[q][1]!r}' AS DOUBLE) + a[3] * CAST('{_rot[q][2]!r}' AS DOUBLE)) * {q + 1}" for q in range(3)) + ") AS BIGINT)")


def _doubled(c: F.Column) -> list[F.Column]:
    return [c[j].cast("double") for j in range(3)]


def _aligned(a: F.Column, b: F.Column) -> F.Column:
    """What remains between ``b`` and ``a`` turned to it, to the millionth of their lengths."""
    v, w = _doubled(a), _doubled(b)
    size = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    turned = quaternion.rotated_by_column(quaternion.between_columns(v, w), v)
    return quaternion.once(turned, lambda t: F.floor((t["x"] + 2 * t["y"] + 3 * t["z"]) / size * 1e6 + 0.5).cast("bigint"))


_vec("v10_rotation_between", _aligned, _mq("(b[1] + 2 * b[2] + 3 * b[3]) / sqrt(CAST(b[1] * b[1] + b[2] * b[2] + b[3] * b[3] AS DOUBLE))"))
_vec(
    "v10_inverse",
    lambda a, b: (lambda q: F.floor((q["w"] + 2 * q["x"] - 3 * q["z"]) * 1e9 + 0.5).cast("bigint"))(quaternion.inverse_column(quaternion.column(a[0], a[1], a[2], a[3]))),
    "CAST(floor((a[1] - 2e0 * a[2] + 3e0 * a[4]) / (a[1] * a[1] + a[2] * a[2] + a[3] * a[3] + a[4] * a[4]) * 1e9 + 0.5) AS BIGINT)",
)
_euler = {"zxz": Quaternion.euler_zxz(0.7, 0.4, -0.3), "zyz": Quaternion.euler_zyz(0.7, 0.4, -0.3)}
_steps = {
    "zxz": "y * cos(0.4e0) - z * sin(0.4e0) AS y, y * sin(0.4e0) + z * cos(0.4e0) AS z, x",
    "zyz": "x * cos(0.4e0) + z * sin(0.4e0) AS x, z * cos(0.4e0) - x * sin(0.4e0) AS z, y",
}
for _name, _q in _euler.items():
    _add(
        f"v11_euler_{_name}",
        lambda s, d, q=_q: i.vectors(s, d).select("vec_id", *(F.floor(c * 1e6 + 0.5).cast("bigint").alias(n) for n, c in zip("xyz", rotate_columns(q, [F.col("a")[j].cast("double") for j in range(3)])))),
        f"""WITH {VECTORS},
        o AS (SELECT vec_id, CAST(a[1] AS DOUBLE) AS x, CAST(a[2] AS DOUBLE) AS y, CAST(a[3] AS DOUBLE) AS z FROM vec),
        p AS (SELECT vec_id, x * cos(-0.3e0) - y * sin(-0.3e0) AS x, x * sin(-0.3e0) + y * cos(-0.3e0) AS y, z FROM o),
        q AS (SELECT vec_id, {_steps[_name]} FROM p),
        r AS (SELECT vec_id, x * cos(0.7e0) - y * sin(0.7e0) AS x, x * sin(0.7e0) + y * cos(0.7e0) AS y, z FROM q)
        SELECT vec_id, {_mq("x")} AS x, {_mq("y")} AS y, {_mq("z")} AS z FROM r""",
    )
_mat = lambda a: F.array(F.slice(a, 1, 3), F.slice(a, 4, 3), F.slice(a, 7, 3))
_vec("v12_matrix_vector", lambda a, b: vectors.total(vectors.matrix_vector(_mat(a), F.slice(b, 1, 3))), "CAST(" + " + ".join(f"a[{3 * p + q + 1}] * b[{q + 1}]" for p in range(3) for q in range(3)) + " AS BIGINT)")
_vec("v12_trace_of_product", lambda a, b: vectors.trace(vectors.matrix_product(_mat(a), _mat(b), 3), 3), "CAST(" + " + ".join(f"a[{3 * p + q + 1}] * b[{3 * q + p + 1}]" for p in range(3) for q in range(3)) + " AS BIGINT)")
_vec("v13_tuple_less", lambda a, b: vectors.tuple_less(F.struct(a[0], a[1]), F.struct(b[0], b[1])), "a[1] < b[1] OR (a[1] = b[1] AND a[2] < b[2])")
_add("f6_complex_quotient", lambda s, d: (lambda g: millionths(g.with_value(complexes.quotient(complexes.make(F.lit(1.0), F.lit(2.0)), complexes.plus(g.value, complexes.make(F.lit(3.0), F.lit(0.0))))["re"])))(i.emb_pairs(s, d)), f"WITH {PAIRS} SELECT x, y, {_mq('((re + 3) + 2 * im) / ((re + 3) * (re + 3) + im * im)')} AS v FROM img")
_add("f6_minus_scaled", lambda s, d: (lambda g: g.with_value(complexes.re(complexes.minus(complexes.scaled(g.value, F.lit(3.0)), complexes.conjugate(g.value)))))(i.emb_pairs(s, d)), f"WITH {PAIRS} SELECT x, y, re * 3.0 - re AS v FROM img")
