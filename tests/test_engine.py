"""Expectations on small grids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright import errors
from gridwright.functions import kernels as k
from gridwright.functions import shapes
from gridwright.functions.shapes import Region
from gridwright.operators import combine, complexes, fourier, index_space, interpolate, iterative, stencil
from gridwright.operators import elementwise as e
from gridwright.operators import reduce as r
from gridwright.operators.grid import Grid
from gridwright.operators.quaternion import Quaternion
from gridwright.sources import procedural as p
from gridwright.sources import raw, tables


def arr(g):
    return tables.to_array(g)


def ids(spark, size):
    return p.unique_id(spark, size)


def board(spark, white, black, tile, size):
    return p.checkerboard(spark, white, black, tile, size)


def one(df):
    return df.first()[0]


# --- sums of generated grids


def test_board_sums(spark):
    a = board(spark, 1, 0, (2, 2), (16, 16))
    b = board(spark, 1, 0, (4, 4), (16, 16))
    assert one(r.total(a)) == 128
    assert one(r.total(combine.linear_combination(1, a, 4, b))) == 640
    assert one(r.total(a * 2 * b + a)) == 128 + 2 * one(r.total(a * b))


def test_board_at_origin_is_black(spark):
    assert arr(board(spark, 1, 0, (1, 1), (2, 2))).tolist() == [[0, 1], [1, 0]]


def test_mirror_pair(spark):
    b = board(spark, 4, 0, (2, 2), (16, 16))
    assert set(arr(b + index_space.mirrored(b, (True, False))).ravel()) == {4}


def test_mirror_ramp(spark):
    x, y = p.mesh_grid(spark, (0, 0), (4, 4))
    g = x + y
    want = np.add.outer(np.arange(4), np.arange(4))[::-1, ::-1]
    assert (arr(index_space.mirrored(g, (True, True))) == want).all()


def test_padded_twice_is_board(spark):
    c = p.constant(spark, 13, (8, 8))
    g = index_space.padded(c, (16, 16), (0, 0), 0) + index_space.padded(c, (16, 16), (8, 8), 0)
    assert (arr(g) == arr(board(spark, 0, 13, (8, 8), (16, 16)))).all()


def test_padded_frame_and_negative_offset(spark):
    c = p.constant(spark, 7, (4, 4))
    want = np.full((8, 8), -1)
    want[2:6, 2:6] = 7
    assert (arr(index_space.padded(c, (8, 8), (2, 2), -1)) == want).all()
    moved = arr(index_space.padded(ids(spark, (3, 1)), (5, 1), (-1, 0), 9))
    assert moved.tolist() == [[1, 2, 9, 9, 0]]


def test_mesh_grid_excludes_its_end(spark):
    for d, g in enumerate(p.mesh_grid(spark, (0, 0, 0), (4, 4, 4))):
        a = arr(g)
        assert a.shape == (4, 4, 4)
        assert (np.moveaxis(a, 2 - d, 0)[3] == 3).all()
    assert arr(p.mesh_grid(spark, (3,), (0,))[0]).tolist() == [3, 2, 1]


def test_slices(spark):
    x, y, z = p.mesh_grid(spark, (0, 0, 0), (8, 8, 8))
    assert (arr(index_space.sliced(y, 1, 3)) == 3).all()
    assert (arr(index_space.sliced(z, 1, 3)) == np.arange(8)[:, None]).all()
    with pytest.raises(errors.SliceOutOfRange):
        index_space.sliced(x, 0, 8)


def test_crop_of_board(spark):
    b = index_space.subview(board(spark, 1, 0, (4, 4), (8, 8)), (2, 2), (4, 4))
    assert (arr(b) == arr(board(spark, 1, 0, (2, 2), (4, 4)))).all()
    with pytest.raises(errors.InvalidRange):
        index_space.subview(b, (2, 2), (4, 4))


def test_crop_of_generator_makes_its_cells_only(spark):
    g = index_space.subview(ids(spark, (1 << 30, 1 << 30)), (7, 9), (3, 2))
    assert "Range (0, 6" in g.cells._jdf.queryExecution().executedPlan().toString()
    assert arr(g)[1, 2] == 9 + (10 << 30)


def test_spikes(spark):
    g = p.constant(spark, 5, (16, 16))
    g = e.for_each_position(g, lambda v, x, y: F.when((x == 4) & (y == 4), 1).when((x == 15) & (y == 0), 10).otherwise(v))
    assert tuple(r.min_max_mean(g).first()) == (1, 10, 5.00390625)
    assert tuple(r.min_max(g.with_value(-g.value)).first()) == (-10, -1)


def test_long_board(spark):
    t = 1 << 31
    g = index_space.subview(board(spark, 1, 0, (t, t), (8 * t, 2)), (t - 1, 0), (2, 1))
    assert arr(g).tolist() == [[0, 1]]


def test_division_truncates(spark):
    a, b = p.constant(spark, 10, (4, 4)), p.constant(spark, 7, (4, 4))
    assert set(arr(a / b).ravel()) == {1} and set(arr(b / a).ravel()) == {0}
    assert set(arr((a * -1) / b).ravel()) == {-1}
    assert set(arr(b - a).ravel()) == {-3}
    assert set(arr(1 - a).ravel()) == {-9} and set(arr(a / 3).ravel()) == {3}
    assert arr(p.constant(spark, 1.0, (2,)) / 0.0).tolist() == [math.inf] * 2
    assert np.isnan(arr(p.constant(spark, 0.0, (2,)) / 0.0)).all()


def test_sizes_must_agree(spark):
    with pytest.raises(errors.IncompatibleViewSizes):
        _ = p.constant(spark, 1, (4, 4)) + p.constant(spark, 1, (4, 5))


def test_one_source_needs_no_join(spark):
    g = ids(spark, (8, 8))
    plan = (g * 2 + g).cells._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_validate(spark):
    g = ids(spark, (4, 4))
    g.validate()
    with pytest.raises(errors.GridError):
        Grid(g.cells.where("x > 0"), (4, 4)).validate()


# --- element-wise


def test_limits_and_thresholds(spark):
    g = tables.from_array(spark, [-2.5, -0.5, 0.5, 2.5])
    assert arr(e.rounded(g)).tolist() == [-3, -1, 1, 3]
    assert arr(e.clamp(g, -1.0, 1.0)).tolist() == [-1, -0.5, 0.5, 1]
    assert arr(e.lower_limit(g, 0.0, 9.0)).tolist() == [9, 9, 0.5, 2.5]
    assert arr(e.upper_limit(g, 0.0)).tolist() == [-2.5, -0.5, 0, 0]
    assert arr(e.cast(g, "int")).tolist() == [-2, 0, 0, 2]
    assert arr(e.threshold(g, 0.0)).tolist() == [0, 0, 255, 255]
    assert arr(e.absolute(g)).tolist() == [2.5, 0.5, 0.5, 2.5]


# --- reductions


def test_dimension_reduce(spark):
    g = p.constant(spark, 1, (8, 6, 4))
    for axis, n in enumerate((8, 6, 4)):
        out = r.dimension_reduce(g, axis, "sum")
        assert set(arr(out).ravel()) == {n} and out.size == tuple(s for d, s in enumerate(g.size) if d != axis)


def test_initial_value_counts_once(spark):
    g = p.constant(spark, 1, (10, 10))
    assert one(r.reduce(g, "sum", 5)) == 105
    assert one(r.reduce(g, "max", 7)) == 7
    assert set(arr(r.dimension_reduce(g, 0, "sum", 2))) == {12}


def test_finite(spark):
    g = tables.from_array(spark, [1.0, 2.0])
    assert one(r.all_finite(g)) is True
    assert one(r.all_finite(g.with_value(g.value / F.lit(1e-300) * F.lit(1e300)))) is False


def test_arg_max_takes_the_first(spark):
    g = tables.from_array(spark, [[1, 5, 2], [5, 0, 0]])
    assert tuple(r.arg_max(g).first()) == (1, 0, 5)
    assert tuple(r.arg_max(g, skip_first=True).first()) == (1, 1, 0)


def test_vector_and_custom_reductions(spark):
    g = p.constant(spark, 0, (5, 5)).with_value(F.array(F.lit(1), F.lit(-2)))
    assert one(r.vector_reduce(g, 2, "sum")) == [25, -50]
    assert one(r.reduce_by(ids(spark, (100,)), lambda v: int(v.max()), lambda v: int(v.max()), "bigint")) == 99


# --- stencils


def padded_by(a, reach, border):
    mode = {"repeat": "edge", "mirror": "reflect", "periodic": "wrap", "zero": "constant"}[border]
    return np.pad(a, [(q, q) for q in reversed(reach)], mode=mode)


def correlate(a, kernel, border):
    big = padded_by(a, kernel.reach, border)
    out = np.zeros(a.shape, a.dtype)
    for at, o in shapes.offsets(kernel.size, kernel.centre):
        w = kernel.weights[tuple(reversed(at))]
        cut = tuple(slice(q + d, q + d + n) for q, d, n in zip(reversed(kernel.reach), reversed(o), a.shape))
        out = out + w * big[cut]
    return out


KERNELS = [k.constant(3, (3, 3)), k.Kernel.of([[0, 0, 5], [0, 2, 0], [0, 0, 3]]), k.Kernel.of([[1, 0, 1]]), k.Kernel.of([[3, 0, 1], [0, 5, 2]], (2, 1)), k.Kernel.of([[1], [2], [-5], [4], [1]])]


@pytest.mark.parametrize("border", ["repeat", "mirror", "periodic", "zero"])
@pytest.mark.parametrize("kernel", range(len(KERNELS)))
def test_convolution(spark, kernel, border):
    g = p.unique_id(spark, (8, 7))
    g = g.with_value(g.value * g.value % 37)
    assert (arr(stencil.convolve(g, KERNELS[kernel], border)) == correlate(arr(g), KERNELS[kernel], border)).all()


@pytest.mark.parametrize("border", ["repeat", "mirror", "periodic", "zero"])
def test_bands_give_the_same(spark, monkeypatch, border):
    g = p.unique_id(spark, (11, 9))
    g = g.with_value(g.value * g.value % 41)
    kernel = k.Kernel.of(np.arange(1, 16).reshape(3, 5))
    want = correlate(arr(g), kernel, border)
    monkeypatch.setattr(stencil, "BAND", 4)
    assert (arr(stencil.convolve(g, kernel, border)) == want).all()


def test_convolution_volume(spark):
    g = ids(spark, (8, 8, 8))
    for kernel in (k.Kernel.of([[[3]], [[-5]], [[2]]], (0, 0, 1)), k.Kernel.of(np.arange(12).reshape(3, 2, 2), (0, 0, 1))):
        assert (arr(stencil.convolve(g, kernel)) == correlate(arr(g), kernel, "repeat")).all()


def test_interior_only(spark):
    got = stencil.convolve(ids(spark, (5, 5)), k.constant(1, (3, 3)), "none")
    rows = {(x.x, x.y): x.v for x in got.cells.collect()}
    assert all((v is None) == (x in (0, 4) or y in (0, 4)) for (x, y), v in rows.items())


def test_mirror_too_wide(spark):
    with pytest.raises(errors.BorderTooWide):
        stencil.convolve(ids(spark, (2, 9)), k.constant(1, (7, 1)), "mirror")


def test_shifted_centre(spark):
    b = board(spark, 1, 0, (3, 3), (32, 32))
    far = np.zeros((3, 3), int)
    far[2, 2] = 1
    near = np.zeros((3, 3), int)
    near[1, 1] = 1
    assert (arr(stencil.convolve(b, k.Kernel.of(far, (1, 1)))) == arr(stencil.convolve(b, k.Kernel.of(near, (0, 0))))).all()


def test_gaussian_separates(spark):
    assert k.gaussian(2.0).size == (9,) and abs(k.gaussian(2.0).weights.sum() - 1) < 1e-12
    g = ids(spark, (20, 20))
    dense = arr(stencil.convolve(g, k.gaussian_nd(2.0, 2.0)))
    lines = arr(stencil.separable(g, (k.gaussian(2.0), k.gaussian(2.0))))
    assert np.allclose(dense, lines, rtol=1e-9)


def test_median_and_morphology(spark):
    g = p.unique_id(spark, (9, 6))
    g = g.with_value(g.value * 7919 % 101)
    a = arr(g)
    big = padded_by(a, (1, 1), "repeat")
    around = np.stack([big[y : y + 6, x : x + 9] for y in range(3) for x in range(3)])
    assert (arr(stencil.median(g, (1, 1))) == np.median(around, axis=0)).all()
    assert (arr(stencil.eroded(g, (1, 1))) == around.min(0)).all()
    assert (arr(stencil.dilated(g, (1, 1))) == around.max(0)).all()


def test_zero_border_of_locator(spark):
    g = p.constant(spark, 1, (4, 3))
    total = stencil.filtered(g, (1, 1), lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v), "zero")
    assert (arr(total) == correlate(np.ones((3, 4), int), k.constant(1, (3, 3)), "zero")).all()


def test_bordered_subview(spark):
    g = ids(spark, (16, 16))
    whole = arr(stencil.convolve(g, KERNELS[3]))
    part = stencil.bordered(g, Region((4, 0), (6, 8)), (2, 1), (2, 1), lambda h: stencil.convolve(h, KERNELS[3]))
    assert (arr(part) == whole[0:8, 4:10]).all()


def test_two_exchanges(spark):
    plan = stencil.convolve(ids(spark, (64, 64)), KERNELS[1]).cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "NestedLoop" not in plan


def test_kernel_helpers():
    assert k.sobel(2, 0).weights.tolist() == [[1, 0, -1], [2, 0, -2], [1, 0, -1]]
    assert [f.tolist() for f in k.sobel(2, 0).separated()] == [[1, 0, -1], [1, 2, 1]]
    assert k.Kernel.of([[1, 2], [3, 4]], (1, 1)).flipped().weights.tolist() == [[4, 3], [2, 1]]
    w = k.sobel(2, 1).separated()
    assert (np.outer(w[1], w[0]) == k.sobel(2, 1).weights).all()


# --- iterative


def test_iterative(spark):
    g = p.unique_id(spark, (9, 9))
    g = g.with_value(g.value * g.value % 53)
    want = arr(g)
    for _ in range(4):
        want = correlate(want, k.laplacian(), "repeat")
    assert (arr(iterative.laplace_iteration(g, 4)) == want).all()
    d = arr(g.with_value(g.value.cast("double")))
    for _ in range(2):
        big = np.pad(d, 1, mode="edge")
        d = d + sum(np.exp(-(((s - d) / 9.0) ** 2)) * (s - d) * 0.2 for s in (big[:-2, 1:-1], big[2:, 1:-1], big[1:-1, :-2], big[1:-1, 2:]))
    assert np.allclose(arr(iterative.anisotropic_diffusion(g, 2, 9.0, 0.2)), d)


def test_richardson_lucy(spark):
    g = board(spark, 9.0, 1.0, (3, 3), (9, 9))
    a, ps = arr(g), k.gaussian_nd(0.7, 0.7)
    est = a.copy()
    for _ in range(2):
        est = est * correlate(a / correlate(est, ps, "repeat"), ps.flipped(), "repeat")
    assert np.allclose(arr(iterative.richardson_lucy(g, ps, 2)), est)


# --- interpolation


def ramp(spark, n, d):
    return p.generated(spark, (n,) * d, lambda at: sum(at[1:], at[0]).cast("double"))


def test_linear_and_cubic_on_ramps(spark):
    g = ramp(spark, 10, 3)
    shift = (0.6, 0.25, 0.75)
    for how, inner in (("linear", slice(0, 9)), ("cubic", slice(2, 7))):
        got = arr(interpolate.resampled(g, (9, 9, 9), lambda at: [a + s for a, s in zip(at, shift)], how))
        want = np.add.outer(np.add.outer(np.arange(9), np.arange(9)), np.arange(9)) + sum(shift)
        assert np.allclose(got[inner, inner, inner], want[inner, inner, inner])


def test_cubic_impulse(spark):
    g = tables.from_array(spark, [0.0, 0, 1, 0, 0, 0])
    assert abs(arr(interpolate.resampled(g, (1,), lambda at: [at[0] + 2.5], "cubic"))[0] - 0.5) < 1e-12


def test_nearest_half_goes_down(spark):
    g = ids(spark, (5,))
    assert arr(interpolate.resampled(g, (4,), lambda at: [at[0] + 0.5], "nearest")).tolist() == [0, 1, 2, 3]


def test_scale_and_geometry(spark):
    g = ramp(spark, 8, 2)
    same = interpolate.geometry_transformation(g, (8, 8), lambda at: at, centred=True)
    assert np.allclose(arr(same), arr(g))
    half = arr(interpolate.geometry_transformation(g, (7, 7), lambda at: at))
    assert np.allclose(half, np.add.outer(np.arange(7), np.arange(7)) + 1)


def test_rotated_board(spark):
    b = p.checkerboard(spark, 1.0, 0.0, (1, 1, 1), (3, 3, 3))
    b = b.with_value(F.col("x") + 10 * F.col("y") + 100.0 * F.col("z"))
    got = arr(interpolate.rotated(b, Quaternion.rotation(-math.pi / 2, (0, 0, 1)), (1.5, 1.5, 1.5)))
    assert np.allclose(got, np.rot90(arr(b), 1, (1, 2))) or np.allclose(got, np.rot90(arr(b), -1, (1, 2)))


# --- spectra


def test_known_transform(spark):
    g = tables.from_array(spark, [[1.0, -1.0], [-1.0, 1.0]])
    assert np.allclose(arr(fourier.forward(g)), [[0, 0], [0, 4]])


@pytest.mark.parametrize("size", [(12,), (8, 6), (7, 5), (4, 6, 5)])
def test_transforms_match_numpy(spark, size):
    g = p.unique_id(spark, size)
    g = g.with_value((g.value * g.value % 19).cast("double"))
    a = arr(g)
    f = fourier.forward(g)
    assert np.allclose(arr(f), np.fft.rfftn(a, axes=[*range(a.ndim - 1), a.ndim - 1]))
    assert f.size == fourier.spectrum_size(size)
    assert np.allclose(arr(fourier.inverse_normalized(f, size[0])), a)
    assert np.allclose(arr(fourier.inverse(f, size[0])), a * a.size)


def test_stacked_transform(spark):
    g = p.unique_id(spark, (6, 5, 3))
    g = g.with_value((g.value % 11).cast("double"))
    whole = arr(fourier.forward(g, stack=(2,)))
    for z in range(3):
        assert np.allclose(whole[z], arr(fourier.forward(index_space.sliced(g, 2, z))))


def test_phase_correlation(spark):
    rng = np.random.default_rng(5)
    a = rng.random((16, 16))
    g = tables.from_array(spark, a.tolist())
    moved = tables.from_array(spark, np.roll(a, (3, 5), (0, 1)).tolist())
    assert tuple(r.arg_max(fourier.phase_correlation(moved, g)).first())[:2] == (5, 3)


def test_full_spectrum(spark):
    a = np.random.default_rng(1).random((4, 6))
    got = arr(index_space.full_spectrum(fourier.forward(tables.from_array(spark, a.tolist()))))
    full = np.fft.fft2(a)
    want = np.array([[full[y % 4, x % 6] for x in range(-3, 4)] for y in range(-2, 3)])
    assert got.shape == (5, 7) and np.allclose(got, want)


def test_phase_shift_uses_the_first_axis(spark):
    a = np.random.default_rng(2).random((4, 8))
    g = tables.from_array(spark, a.tolist())
    f = complexes.phase_shift(fourier.forward(g), (3.0, 1.0), g.size)
    assert np.allclose(arr(fourier.inverse_normalized(f, 8)), np.roll(a, 3, 1))


# --- numbers on the driver


def test_quaternions():
    q = Quaternion.rotation(math.pi / 2, (0, 0, 1))
    assert np.allclose(q.rotate((1, 0, 0)), (0, 1, 0))
    assert np.allclose(Quaternion.between((1, 0, 0), (0, 2, 0)).rotate((1, 0, 0)), (0, 1, 0))
    i = q * q.inverted()
    assert np.allclose((i.w, i.x, i.y, i.z), (1, 0, 0, 0))
    h = Quaternion.hopf(0.4, 0.9, 1.3)
    assert abs(h.squared - 1) < 1e-12 and abs(h.x - math.cos(0.2) * math.sin(0.65)) < 1e-12
    z = Quaternion.euler_zxz(0.3, 0.0, 0.4)
    w = Quaternion.rotation(0.7, (0, 0, 1))
    assert np.allclose((z.w, z.z), (w.w, w.z))
    assert np.allclose(Quaternion.euler_zyz(0.1, 0.2, 0.3).squared, 1)
    with pytest.raises(errors.GridError):
        Quaternion.between((1, 0, 0), (-1, 0, 0))


def test_shapes():
    assert shapes.linear_index((3, 2, 1), (5, 4, 3)) == 3 + 5 * (2 + 4)
    assert shapes.index_of(33, (5, 4, 3)) == (3, 2, 1)
    assert shapes.wrap_to_index(1, (5, 4)) == (0, 1)
    assert shapes.largest_batch(1, 10, 35, lambda n: 5 * n) == (7, 35)
    assert shapes.largest_batch(3, 2, 9, lambda n: n) == (0, 0)
    assert shapes.largest_batch(3, 9, 2, lambda n: n) == (-1, -1)
    assert Region((0, 1), (2, 2)).grown((1, 1), (0, 0)).clamped((5, 5)) == Region((0, 0), (2, 3))
    assert shapes.sum_each_neighbour((0, 0), (2, 3), lambda i: i[0] + i[1]) == 9


# --- files


@pytest.mark.parametrize("size", [(12,), (12, 16), (12, 16, 18)])
def test_raw_round_trip(spark, tmp_path, size):
    rng = np.random.default_rng(1337)
    a = rng.random(tuple(reversed(size))).astype("f4").astype(float)
    g = tables.from_array(spark, a.tolist())
    path = raw.dump(g, str(tmp_path / "test"), "32F")
    assert path.endswith("test_32F_" + "x".join(map(str, size)) + ("x1" if len(size) == 1 else "") + ".raw")
    again = raw.load(spark, path)
    assert np.array_equal(arr(again).reshape(a.shape), a)


def test_raw_channels_and_range(spark, tmp_path):
    g = p.index_view(spark, (3, 2))
    path = raw.dump(g, str(tmp_path / "v"), "16S")
    assert path.endswith("v_16SC2_3x2.raw")
    assert arr(raw.load(spark, path)).shape == (2, 3, 2)
    with pytest.raises(Exception, match="don't fit"):
        raw.dump(p.constant(spark, 300, (2, 2)), str(tmp_path / "x"), "8U")


def test_images(spark, tmp_path):
    g = p.unique_id(spark, (5, 4))
    path = str(tmp_path / "a.pgm")
    raw.write_image(g, path)
    assert (arr(raw.read_image(spark, path)) == arr(g)).all()


@pytest.mark.parametrize(("channels", "most"), [(1, 255), (3, 65535), (4, 255), (4, 65535), (1, None), (3, None)])
def test_image_layouts(spark, tmp_path, channels, most):
    rng = np.random.default_rng(channels)
    a = rng.random((3, 5, channels)).astype("f4").astype("f8") if most is None else rng.integers(0, most + 1, (3, 5, channels))
    kind = "double" if most is None else "bigint"
    rows = [(x, y, a[y, x].tolist() if channels > 1 else a[y, x, 0].item()) for y in range(3) for x in range(5)]
    g = Grid(spark.createDataFrame(rows, f"x bigint, y bigint, v {f'array<{kind}>' if channels > 1 else kind}"), (5, 3))
    path = str(tmp_path / "image")
    raw.write_image(g, path, most or 255)
    again = raw.read_image(spark, path)
    assert again.size == (5, 3) and sorted(map(tuple, again.cells.collect())) == sorted(rows)


def test_text_tables(spark, tmp_path):
    (tmp_path / "k.txt").write_text("1 2  3\n4 5 6\n")
    assert tables.read_kernel(spark, str(tmp_path / "k.txt")).tolist() == [[1, 2, 3], [4, 5, 6]]


# --- streams


def test_custom_reduction_runs_in_many_tasks(spark):
    from gridwright.operators import reduce as r

    g = p.unique_id(spark, (1000,))
    out = r.reduce_by(g, lambda v: int(v.max()), lambda v: int(v.max()), "bigint")
    assert out.first().v == 999 and "Exchange SinglePartition" in out._jdf.queryExecution().toString() or "RoundRobinPartitioning(1)" in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("n", [5000, 4099 * 2, 1 << 13])
def test_long_signals_are_split(spark, n, monkeypatch):
    monkeypatch.setattr(fourier, "LONG_LINE", 100)
    x = np.random.default_rng(n).random(n)
    g = Grid(spark.createDataFrame(list(enumerate(x.tolist())), "x bigint, v double"), (n,))
    got = {r.x: complex(r.v.re, r.v.im) for r in fourier.forward(g).cells.collect()}
    want = np.fft.rfft(x)
    assert len(got) == len(want) and np.allclose([got[i] for i in range(len(want))], want)
    back = {r.x: r.v for r in fourier.inverse_normalized(fourier.forward(g), n).cells.collect()}
    assert np.allclose([back[i] for i in range(n)], x)


def test_slabs_are_written_by_executors(spark, tmp_path):
    g = p.unique_id(spark, (7, 5, 3))
    raw.dump_slabs(g, str(tmp_path / "slabs"), "32S", 20)
    again = raw.from_slabs(spark.read.parquet(str(tmp_path / "slabs")), "32S", (7, 5, 3), 20)
    assert sorted(map(tuple, again.cells.collect())) == sorted(map(tuple, g.cells.collect()))


def test_stream_of_slices(spark, tmp_path):
    from gridwright.streaming.frames import per_slice

    p.unique_id(spark, (4, 3, 2)).cells.write.parquet(str(tmp_path / "in"))
    cells = spark.readStream.schema("x bigint, y bigint, z bigint, v bigint").parquet(str(tmp_path / "in"))
    query = per_slice(cells, (4, 3, 2), lambda g: g.with_value(g.value * 2), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).selectExpr("sum(v)").first()[0] == 2 * sum(range(24))


# --- rendering and user strategies


def test_rays_blend_front_to_back(spark):
    from gridwright.operators import render

    rng = np.random.default_rng(4)
    c, a = rng.random((5, 3, 4)), rng.random((5, 3, 4))
    both = combine.n_ary(lambda p_, q: F.struct(p_.alias("c"), q.alias("a")), tables.from_array(spark, c.tolist()), tables.from_array(spark, a.tolist()))
    want, left = np.zeros((3, 4)), np.ones((3, 4))
    for z in range(5):
        want, left = want + left * a[z] * c[z], left * (1 - a[z])
    assert np.allclose(arr(render.composited(both)), want)
    flat = p.constant(spark, 10.0, (3, 3, 2))
    lit = arr(render.ray_cast(flat, render.table_transfer((1.0,), (0.5,), 0.0, 20.0)))
    assert np.allclose(lit, 0.75 * 0.3)  # no gradient: ambient light only


def test_user_interpolation_and_border(spark):
    g = ids(spark, (5,))
    far = interpolate.resampled(g, (7,), lambda at: [at[0] - 1], lambda q: [(F.floor(q).cast("bigint"), F.lit(2.0))], lambda c, n: F.when(c < 0, n - 1).when(c < n, c))
    assert arr(far).tolist() == [8, 0, 2, 4, 6, 8, 0]


@pytest.mark.parametrize("border", ["repeat", "mirror", "periodic", "zero"])
def test_lines_as_arrays_need_no_shuffle_along_x(spark, border):
    a = np.arange(7 * 9).reshape(7, 9) ** 2 % 43
    rows = spark.createDataFrame([(y, a[y].tolist()) for y in range(7)], "row bigint, line array<int>")
    g = tables.from_rows(rows, "row", "line", 9, 7)
    for kernel in (k.Kernel.of([[1, -2, 3, 4, 5]], (1, 0)), KERNELS[3], k.Kernel.of(np.arange(9).reshape(3, 3))):
        assert (arr(stencil.convolve(g, kernel, border)) == correlate(a, kernel, border)).all()
    flat = stencil.convolve(g, k.Kernel.of([[1, -2, 3]]), border).cells._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in flat
    assert (arr(stencil.dilated(g, (1, 1), "repeat")) == np.max([padded_by(a, (1, 1), "repeat")[y : y + 7, x : x + 9] for y in range(3) for x in range(3)], axis=0)).all()
