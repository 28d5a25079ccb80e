"""Round trips of elements that lie half way between two millionths, or ten thousandths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridwright.plans import catalogue

ROWS = 520


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """Embeddings whose elements times a million (one in 128) or ten thousand (one in 32) end in a half, among others."""
    rng = np.random.default_rng(5)
    a = rng.normal(0, 0.125, (ROWS, 64)).astype(np.float32)
    a[::2] = (2 * rng.integers(-32, 32, a[::2].shape) + 1) / 128
    a[1::4] = (2 * rng.integers(-8, 8, a[1::4].shape) + 1) / 32
    folder = tmp_path_factory.mktemp("halves")
    pq.write_table(pa.table({"vec_id": np.arange(ROWS), "embedding": pa.array(list(a), pa.list_(pa.float32())), "label": np.zeros(ROWS, np.int32)}), folder / "embeddings.parquet")
    return str(folder), a.astype(float)


@pytest.mark.parametrize("name", ["f1_long_signal_round_trip", "f1_prime_length_round_trip", "f1_round_trip", "f1_tall_round_trip"])
def test_round_trips_of_halves(spark, halves, name):
    folder, a = halves
    want = np.floor(a * 1e6 + 0.5).astype(int)
    got = {(r.x, r.y): r.v for r in catalogue.queries()[name](spark, folder).collect()}
    assert [got.pop((x, y)) for y in range(ROWS) for x in range(64)] == want.reshape(-1).tolist()
    assert not any(got.values())  # the zeros behind a signal of a prime length


def test_deconvolution_of_halves(spark, halves):
    folder, a = halves
    rounded = np.trunc(np.abs(a) * 1e4 + 0.5) * np.sign(a) / 1e4
    want = np.floor(rounded * 1e6 + 0.5).astype(int)
    got = {(r.x, r.y): r.v for r in catalogue.queries()["f5_wiener"](spark, folder).collect()}
    assert [got[x, y] for y in range(ROWS) for x in range(64)] == want.reshape(-1).tolist()
