from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm.bitslice import add_weighted, pack_slices, read_sums, search_block, top_inner_products

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def test_sums_by_bitmaps_are_inner_products():
    rng = np.random.default_rng(1)
    v, q = rng.integers(-600, 600, (200, 9)), rng.integers(-600, 600, 9)
    q[3] = 0
    total, offset = add_weighted(pack_slices(v, 11), q)
    assert read_sums(total, np.arange(200), offset) == (v @ q).tolist()


def test_block_keeps_the_first_ids_of_boundary_rows():
    v = np.array([[1, 0]] * 70 + [[2, 0]] * 3)
    got = search_block(pack_slices(v, 3), np.arange(73), np.array([1, 1]), 71, 5)
    assert got[:2] == [(70, 2), (72, 2)] and [i for i, _ in got[2:]] == [0, 1, 2]


def brute(rows, k):
    rows = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in rows:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(6)]) for i in range(0, 900, 3)]
    rows += [(i, [0.5, -0.25, 0.0, 0.1, 0.0, 0.3]) for i in range(1000, 1400)]
    rows += [(5000, None), (5100, [None, 1.0]), (5200, [float("nan")] * 6), (5300, [float("inf")] * 6), (None, [1.0] * 6), (5400, [2.0]), (5500, [])]
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    want = brute(rows, 10)
    for small in (64, 8192):
        got = top_inner_products(docs, F.col("vec_id") % 100 == 0, k=10, rows=small).collect()
        assert sorted(map(tuple, got)) == want


def test_empty_and_few(spark):
    assert top_inner_products(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1, "x"), (1, [0.5], 1, "x")], SCHEMA)
    assert [tuple(r) for r in top_inner_products(one, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 512)]


def test_components_of_any_size(spark):
    """Up to 10**7 among small ones, and of 2**60 and more where scores still fit."""
    rnd = random.Random(5)
    sizes = (0.1, -0.3, 1e3, -2e4, 1e7, -1e7, 3.5)
    rows = [(i, [rnd.choice(sizes if i % 100 else (0.1, 50.0, -1e4)) * rnd.random() for _ in range(8)]) for i in range(400)]
    rows += [(700, [1.0] + [0.0] * 63), (701, [150_000.0] + [0.0] * 63), (702, [0.0] * 63 + [-149_999.5])]
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    for small in (64, 8192):
        got = top_inner_products(docs, F.col("vec_id") % 100 == 0, k=10, rows=small).collect()
        assert sorted(map(tuple, got)) == brute(rows, 10)
    far = spark.createDataFrame([(100, [2.0**-10, 0.0], 1, "x"), (1, [2.0**52, 1e30], 1, "x"), (2, [-(2.0**52), -1e30], 1, "x"), (3, [0.0, 1.0], 1, "x")], SCHEMA)
    assert [tuple(r) for r in top_inner_products(far, F.col("vec_id") == 100).collect()] == [(100, 1, 1, 1 << 62), (100, 2, 3, 0), (100, 3, 2, -(1 << 62))]
    with pytest.raises(Exception, match="doesn't fit into a long"):
        top_inner_products(far, F.col("vec_id") == 3).collect()
