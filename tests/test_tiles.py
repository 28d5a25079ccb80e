"""Tiles, filters that don't depend on the window, long transforms, resampling and views, against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.errors import BorderTooWide, GridError
from gridwright.functions import kernels as k
from gridwright.functions import shapes
from gridwright.operators import fourier, interpolate, iterative, render, stencil, tiles
from gridwright.operators.grid import Grid
from gridwright.sources import procedural as p
from gridwright.sources import tables

MODES = {"repeat": "edge", "mirror": "reflect", "periodic": "wrap", "zero": "constant"}


def arr(g):
    return tables.to_array(g)


def sample(spark, size, by=7919, of=101):
    g = p.unique_id(spark, size)
    return g.with_value((g.value * g.value * by + g.value * 31) % of).settled()


def plan(g):
    return (g.cells if isinstance(g, Grid) else g)._jdf.queryExecution().executedPlan().toString()


def around(a, low, high, border):
    """Every cell's box as the last axis."""
    big = np.pad(a, [(l, h) for l, h in zip(reversed(low), reversed(high))], mode=MODES[border])
    box = np.lib.stride_tricks.sliding_window_view(big, [l + h + 1 for l, h in zip(reversed(low), reversed(high))])
    return box.reshape(*a.shape, -1)


@pytest.fixture
def small_tiles(monkeypatch):
    """Tiles of a few cells.  What runs in workers is told by arguments, so this changes how grids are cut and nothing else."""
    monkeypatch.setattr(tiles, "CELLS", 40)
    monkeypatch.setattr(tiles.tile_size, "__defaults__", (40,))
    monkeypatch.setattr(tiles.by_tiles, "__defaults__", (*tiles.by_tiles.__defaults__[:-1], 40))
    monkeypatch.setattr(interpolate, "TILE", 40)


def test_tile_sizes():
    assert tiles.tile_size((64, 5000), 1 << 16) == (64, 1024)
    assert tiles.tile_size((5000, 5000), 1 << 16) == (256, 256)
    assert tiles.tile_size((7, 12, 7), 1 << 16) == (7, 12, 7)
    assert tiles.tile_size((10**9,), 1 << 16) == (1 << 16,)
    assert tiles.tile_size((3, 10**6, 10**6), 1 << 16) == (3, 148, 147)


@pytest.mark.parametrize("border", list(MODES))
@pytest.mark.parametrize(("size", "low", "high"), [((23, 17), (2, 3), (2, 3)), ((23, 17), (0, 4), (3, 0)), ((50,), (6,), (6,)), ((7, 6, 9), (1, 2, 1), (1, 2, 1))])
def test_filters_equal_numpy(spark, small_tiles, border, size, low, high):
    g = sample(spark, size)
    box = around(arr(g), low, high, border)
    assert (arr(stencil.boxed(g, low, high, border)) == box.sum(-1)).all()
    if low == high:
        assert (arr(stencil.eroded(g, low, border)) == box.min(-1)).all()
        assert (arr(stencil.dilated(g, low, border)) == box.max(-1)).all()
        assert (arr(stencil.median(g, low, border)) == np.median(box, -1)).all()


def test_periodic_reach_beyond_the_grid(spark, small_tiles):
    g = sample(spark, (5, 9))
    box = around(arr(g), (7, 11), (7, 11), "periodic")
    assert (arr(stencil.boxed(g, (7, 11), (7, 11), "periodic")) == box.sum(-1)).all()
    assert (arr(stencil.eroded(g, (7, 11), "repeat")) == around(arr(g), (7, 11), (7, 11), "repeat").min(-1)).all()
    with pytest.raises(BorderTooWide):
        stencil.eroded(g, (5, 1), "mirror")


def test_interior_only(spark, small_tiles):
    g = sample(spark, (12, 11))
    want = around(arr(g), (2, 1), (2, 1), "repeat").max(-1)
    for r in stencil.dilated(g, (2, 1), "none").cells.collect():
        inside = 2 <= r.x < 10 and 1 <= r.y < 10
        assert r.v == (want[r.y, r.x] if inside else None)


@pytest.mark.parametrize("dtype", [int, float])
def test_ranks_of_boxes(dtype):
    rng = np.random.default_rng(1)
    for shape, widths in (((40, 31), (7, 5)), ((40, 31), (1, 1)), ((9, 8, 7), (3, 2, 4)), ((30,), (30,)), ((6, 6), (6, 6))):
        block = rng.integers(0, 9, shape).astype(dtype)
        want = np.sort(np.lib.stride_tricks.sliding_window_view(block, widths[::-1]).reshape(*[s - w + 1 for s, w in zip(shape, widths[::-1])], -1), -1)
        for rank in {0, want.shape[-1] // 2, want.shape[-1] - 1}:
            got = tiles.sliding_rank(block, widths, rank)
            assert got.dtype == block.dtype and (got == want[..., rank]).all()


def test_not_a_number_is_the_largest():
    block = np.array([3.0, np.nan, 1.0, 2.0])
    assert tiles.sliding_extreme(block, [2], False).tolist() == [3.0, 1.0, 1.0]
    assert np.isnan(tiles.sliding_extreme(block, [2], True)[:2]).all()
    assert tiles.sliding_rank(block, [3], 1).tolist() == [3.0, 2.0]


def test_price_of_a_window_does_not_follow_its_width():
    """Sweeps and ranks do the same work for any box: calls are counted, not time."""
    calls = []

    class Counted(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
            calls.append(sum(np.size(x) for x in inputs if isinstance(x, np.ndarray)))
            inputs = [x.view(np.ndarray) if isinstance(x, Counted) else x for x in inputs]
            return getattr(ufunc, method)(*inputs, **kwargs).view(Counted)

    counts = []
    for width in (3, 51):
        calls.clear()
        tiles.sliding_extreme(np.zeros((300, 300)).view(Counted), [width, width], True)
        counts.append(sum(calls))
    assert counts[1] < 1.3 * counts[0]


def test_one_exchange_for_any_window(spark):
    g = sample(spark, (300, 300))
    for radius in ((1, 1), (25, 25)):
        assert plan(stencil.eroded(g, radius)).count("Exchange") == 1


def correlate(a, kernel, border):
    reach = kernel.reach
    big = np.pad(a.astype(float), [(q, q) for q in reversed(reach)], mode=MODES[border])
    out = np.zeros(a.shape)
    for at, o in shapes.offsets(kernel.size, kernel.centre):
        cut = tuple(slice(q + d, q + d + n) for q, d, n in zip(reversed(reach), reversed(o), a.shape))
        out = out + kernel.weights[tuple(reversed(at))] * big[cut]
    return out


RNG = np.random.default_rng(6)
DENSE = [k.gaussian_nd(2.5, 2.5), k.Kernel.of(RNG.random((31, 31))), k.Kernel.of(RNG.random((9, 12)), (11, 0)), k.Kernel.of(RNG.random((9, 9)), (12, -2)), k.Kernel.of(np.add.outer(RNG.random(10), RNG.random(11)))]


@pytest.mark.parametrize("border", list(MODES))
@pytest.mark.parametrize("kernel", range(len(DENSE)))
def test_many_weights(spark, kernel, border):
    g = sample(spark, (40, 37))
    g = g.with_value(g.value / 7.0)
    assert np.allclose(arr(stencil.convolve(g, DENSE[kernel], border)), correlate(arr(g), DENSE[kernel], border), atol=1e-9)


def test_many_weights_on_small_tiles(spark, small_tiles):
    g = sample(spark, (25, 19)).with_value(F.col("v") / 3.0)
    for kernel in DENSE[:2]:
        for lines in (0, 10_000):
            assert np.allclose(arr(stencil.dense(g, kernel, "mirror" if kernel.size[0] < 19 else "zero", lines)), correlate(arr(g), kernel, "mirror" if kernel.size[0] < 19 else "zero"), atol=1e-9)


def test_volume_of_weights(spark):
    kernel = k.Kernel.of(RNG.random((5, 4, 5)), (0, 3, 2))
    g = sample(spark, (9, 8, 10))
    assert np.allclose(arr(stencil.convolve(g, kernel)), correlate(arr(g), kernel, "repeat"), atol=1e-9)
    assert len(k.gaussian_nd(1.0, 2.0, 1.5).low_rank()) == 1 and len(DENSE[4].low_rank()) == 2


@pytest.mark.parametrize("border", list(MODES))
def test_wide_box_of_whole_numbers_is_exact(spark, border):
    g = sample(spark, (60, 55))
    kernel = k.constant(-4, (21, 30), (3, 29))
    got = stencil.convolve(g, kernel, border)
    assert (arr(got) == correlate(arr(g), kernel, border)).all() and plan(got).count("Exchange") == 1
    one_sided = k.constant(1, (70, 1), (-1, 0))
    assert (arr(stencil.convolve(g, one_sided)) == correlate(arr(g), one_sided, "repeat")).all()


# --- rounds in blocks


@pytest.mark.parametrize("border", list(MODES))
@pytest.mark.parametrize("at_once", [1, 4])
def test_rounds_in_blocks(spark, small_tiles, border, at_once):
    g = sample(spark, (17, 14))
    want = arr(g)

    def step(a):
        return a[:-2, 1:-1] + a[1:-1, :-2] - 4 * a[1:-1, 1:-1] + a[1:-1, 2:] + 2 * a[2:, 1:-1]

    for _ in range(6):
        want = step(np.pad(want, 1, mode=MODES[border]))
    assert (arr(iterative.in_blocks(g, step, 6, 1, border, at_once)) == want).all()


@pytest.mark.parametrize("border", list(MODES))
def test_deconvolution_in_blocks(spark, small_tiles, border):
    g = sample(spark, (19, 16)).with_value(F.col("v") + 1.5)
    spread = k.Kernel.of([[1, 4, 2, 1], [2, 6, 3, 1], [1, 2, 1, 0]], (1, 2))
    spread = k.Kernel(spread.weights / spread.weights.sum(), spread.centre)
    a = want = arr(g)
    for _ in range(3):
        want = want * correlate(a / correlate(want, spread, border), spread.flipped(), border)
    got = iterative.richardson_lucy(g, spread, 3, border)
    assert np.allclose(arr(got), want) and plan(got).count("Exchange") == 1


def test_rounds_share_shuffles(spark):
    g = sample(spark, (40, 40))
    assert plan(iterative.laplace_iteration(g, 8)).count("Exchange") == 1


def test_whole_numbers_that_grow_too_large(spark):
    g = p.unique_id(spark, (4, 4)).with_value(F.col("x") * (1 << 61))
    with pytest.raises(Exception, match="whole numbers"):
        iterative.laplace_iteration(g, 1).cells.collect()


def test_rounds_of_other_grids(spark):
    g = sample(spark, (6, 5))
    got = {(r.x, r.y): r.v for r in iterative.laplace_iteration(g, 1, "none").cells.collect()}
    assert got[0, 0] is None and got[2, 2] is not None


# --- transforms of any length


@pytest.fixture
def short_lines(monkeypatch):
    monkeypatch.setattr(fourier, "LONG_LINE", 8)


@pytest.mark.parametrize("size", [(61,), (1009,), (512,), (7, 30), (30, 7), (11, 13), (1, 64), (4, 60, 3), (17, 2, 12), (2 * 37, 5)])
def test_any_axis_of_any_length(spark, short_lines, size):
    rng = np.random.default_rng(len(size) + size[0])
    a = rng.random(size[::-1])
    g = tables.from_array(spark, a)
    f = fourier.forward(g)
    assert np.allclose(arr(f), np.fft.rfftn(a, axes=[*range(a.ndim - 1), a.ndim - 1])) and f.size == fourier.spectrum_size(size)
    assert np.allclose(arr(fourier.inverse_normalized(f, size[0])), a)


@pytest.mark.parametrize("stack", [(0,), (1,), (0, 2), (1, 2)])
def test_long_axes_of_stacks(spark, short_lines, stack):
    a = np.random.default_rng(3).random((9, 22, 10))
    g = tables.from_array(spark, a)
    axes = [2 - d for d in range(2, -1, -1) if d not in stack]
    got = fourier.forward(g, stack)
    assert np.allclose(arr(got), np.fft.rfftn(a, axes=axes))
    first = next(d for d in range(3) if d not in stack)
    assert np.allclose(arr(fourier.inverse_normalized(got, g.size[first], stack)), a)


def test_no_long_arrays(spark, monkeypatch):
    """Of a tall image no task gathers more than a line of the longest length."""
    seen = []
    monkeypatch.setattr(fourier, "_lines", lambda df, keys, axis, took, length, f, ready=None: seen.append((took, length)) or df)
    g = p.constant(spark, 1.0, (4, 3_000_000)).settled()
    fourier.forward(g, stack=(0,))
    assert seen and max(max(x) for x in seen) <= fourier.LONG_LINE
    assert fourier._part(4099 * 2) is None and fourier._part(1 << 22) == 4096 and fourier._part(3_000_000) <= 4096


# --- resampling on tiles


def read(a, points, how, border):
    """The value at each point (x first) by taps."""
    out = []
    for pt in points:
        total = 0.0
        axes = [[(int(c[0]), float(w[0])) for c, w in interpolate._taps(np.array([q]), how)] for q in pt]
        for taps in np.ndindex(*(len(x) for x in axes)):
            chosen = [axes[d][t] for d, t in enumerate(taps)]
            where, weight = [], 1.0
            for (c, w), n in zip(chosen, a.shape[::-1]):
                c = int(interpolate._shown(np.array([c]), n, border)[0])
                where.append(c if 0 <= c < n else None)
                weight *= w
            if weight and None not in where:
                total += weight * a[tuple(reversed(where))]
        out.append(total)
    return out


@pytest.mark.parametrize("border", list(MODES))
@pytest.mark.parametrize("how", ["nearest", "linear", "cubic"])
@pytest.mark.parametrize("size", [(23, 17), (50,), (6, 9, 7)])
def test_points_anywhere(spark, small_tiles, size, how, border):
    rng = np.random.default_rng(7)
    a = rng.random(size[::-1])
    reach = 0.9 if border == "mirror" else 3.0
    points = [tuple(rng.uniform(-reach * n, (1 + reach) * n) if i % 3 else rng.uniform(0, n - 1) for n in size) for i in range(150)]
    points += [tuple(float(v) for v in rng.integers(-2, 9, len(size))) for _ in range(50)]
    if border == "mirror":
        points = [tuple(min(max(q, 4.0 - n), 2 * n - 6.0) for q, n in zip(pt, size)) for pt in points]
    df = spark.createDataFrame([(f"k{i}", i % 5 or None, *pt) for i, pt in enumerate(points)], ["name", "n", *"abc"[: len(size)]]).repartition(2)
    got = interpolate.sampled(tables.from_array(spark, a), df, [F.col(c) for c in "abc"[: len(size)]], ["name", "n"], how, border)
    assert got.columns == ["name", "n", "v"]
    rows = {r.name: r for r in got.collect()}
    assert len(rows) == len(points) and all(rows[f"k{i}"].n == (i % 5 or None) for i in range(len(points)))
    assert np.allclose([rows[f"k{i}"].v for i in range(len(points))], read(a, points, how, border))


def test_taps_agree_with_columns(spark):
    df = spark.createDataFrame([(x,) for x in np.linspace(-3, 5, 57).tolist()], "p double")
    for how, f in interpolate.TAPS.items():
        rows = df.select("p", *(F.struct(c.alias("c"), w.alias("w")).alias(f"t{i}") for i, (c, w) in enumerate(f(F.col("p"))))).collect()
        for r in rows:
            for i, (c, w) in enumerate(interpolate._taps(np.array([r.p]), how)):
                assert r[f"t{i}"].c == c[0] and abs(r[f"t{i}"].w - w[0]) < 1e-12


def test_shuffled_rows_do_not_follow_the_taps(spark):
    g = p.unique_id(spark, (40, 30)).with_value(F.col("x").cast("double"))
    plans = [plan(interpolate.resampled(g, (50, 50), lambda at: [a * 0.7 for a in at], how)) for how in ("linear", "cubic")]
    assert all("Generate explode(array(struct" not in x for x in plans) and plans[0].count("Exchange") == plans[1].count("Exchange")


def test_places_come_tile_by_tile(spark):
    for size in ((3,), (70, 200), (5, 6, 7), (5000, 3)):
        rows = [tuple(r) for r in interpolate.in_tiles(spark, size).collect()]
        assert len(rows) == len(set(rows)) == math.prod(size) and all(0 <= c < n for r in rows for c, n in zip(r, size))


def test_whole_numbers_are_truncated(spark):
    g = p.unique_id(spark, (4, 3)).with_value(F.col("x") - 2)
    got = arr(interpolate.resampled(g, (3, 3), lambda at: [at[0] + 0.5, at[1]]))
    assert got.dtype == np.int64 and got.tolist() == [[-1, 0, 0]] * 3


def test_unknown_border(spark):
    with pytest.raises(GridError):
        interpolate.resampled(p.constant(spark, 1, (3,)), (3,), lambda at: at, "linear", "wrong")


# --- views of volumes


def test_bands_of_rays_blend_as_whole_rays(spark, monkeypatch):
    rng = np.random.default_rng(2)
    samples = [(x, z, float(c), float(d), float(a)) for x in range(3) for z in range(130) for c, d, a in [rng.random(3) * (1, 1, 0.1)] if z % 3 != x]
    df = spark.createDataFrame(samples, "x int, z int, r double, g double, a double").repartition(5)
    want = {}
    for x, _, r, g, a in sorted(samples):
        s = want.setdefault(x, [0.0, 0.0, 1.0])
        want[x] = [s[0] + s[2] * a * r, s[1] + s[2] * a * g, s[2] * (1 - a)]
    for band in (64, 4, 2):
        monkeypatch.setattr(render, "BAND", band)
        got = {r.x: [r.r, r.g, r["left"]] for r in render.blended(df, ["x"], "z", 130, ["r", "g"]).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[x], want[x]) for x in got)


@pytest.mark.parametrize("eye", [None, (2.0, 3.0, -9.0)])
def test_view_equals_a_walk_along_each_ray(spark, eye):
    rng = np.random.default_rng(8)
    a = rng.random((5, 7, 6))
    camera = render.Camera((-1.0, 0.5, -2.0), (0.8, 0.0, 0.1), (0.0, 0.9, 0.0), None if eye else (0.2, 0.1, 1.0), eye)
    got = render.viewed(tables.from_array(spark, a), camera, (8, 7), 40, 0.3, lambda v: ([v, 1 - v, v * v], v * 0.2))
    seen = {(r.x, r.y): [r.c0, r.c1, r.c2, r["left"]] for r in got.collect()}
    assert len(seen) == 56
    for (x, y), pixel in seen.items():
        start = np.array(camera.corner) + x * np.array(camera.across) + y * np.array(camera.down)
        way = start - np.array(eye) if eye else np.array(camera.direction)
        way = way / np.linalg.norm(way)
        c, left = np.zeros(3), 1.0
        for z in range(40):
            q = start + z * 0.3 * way
            if all(0 <= s <= n - 1 for s, n in zip(q, a.shape[::-1])):
                (v,) = read(a, [tuple(q)], "linear", "repeat")
                c += left * v * 0.2 * np.array([v, 1 - v, v * v])
                left *= 1 - v * 0.2
        assert np.allclose(pixel, [*c, left])
    assert any(x[3] == 1.0 for x in seen.values()) and any(x[3] < 0.9 for x in seen.values())


def test_line_pass_computes_each_line_once(spark):
    """No filter repeats the line's expression for every tap."""
    df = spark.createDataFrame([(i, [float(i + j) for j in range(20)]) for i in range(4)], "y bigint, a array<double>")
    g = tables.from_rows(df, "y", "a", 20, 4, lambda e: F.floor(e * 10).cast("bigint"))
    text = plan(stencil.convolve(g, k.Kernel.of([[1, 2, 3, 4, 5]])))
    assert "Filter (size(transform" not in text and text.count("FLOOR") <= 4
