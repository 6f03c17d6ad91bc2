from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm.common import table
from driftwell.llm.learned import balanced_parts, fit_router, nearest_neighbours, neighbour_graph, parts_for
from driftwell.llm.q_learned import op8_learned_ann

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string"


def brute(rows, k=20, every=20):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    x = np.stack([v for _, v in rows])
    out = {}
    for i, v in rows:
        if i % every == 0:
            s = (x * v).sum(axis=1)
            out[i] = [(j, t) for t, j in sorted((-t, j) for t, (j, _) in zip(s, rows) if j != i)[:k]]
    return out


def recall(got, want):
    found = defaultdict(set)
    for r in got:
        found[r.query_id].add(r.vec_id)
    return sum(len(found[q] & {j for j, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((4, 8)) * 3
    x = np.concatenate([c + rng.standard_normal((100, 8)) * 0.1 for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = balanced_parts(neighbour_graph(x, 5), 4)
    assert np.bincount(part).tolist() == [100] * 4
    assert all(len(set(part[i : i + 100])) == 1 for i in range(0, 400, 100))
    router = fit_router(x, 4, k=10)
    assert router.probes == 1


def test_recall_and_order(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    got = op8_learned_ann(spark, sf_dir).collect()
    assert recall(got, brute(rows)) >= 0.9
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    ranked = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        assert abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-12 and r.vec_id != r.query_id
        ranked[r.query_id].append((r["rank"], -r.score, r.vec_id))
    for x in ranked.values():
        assert [a for a, _, _ in x] == list(range(1, 21)) and [(b, c) for _, b, c in x] == sorted((b, c) for _, b, c in x)


def test_ties_go_to_small_ids(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(1200)] + [(2000 + i, [1.0] * 8) for i in range(900)]
    rows += [(9000, None), (9020, [0.0] * 8), (9040, [None] + [1.0] * 7), (9060, [float("inf")] * 8), (None, [1.0] * 8)]
    vectors = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)
    got = nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, rows=256, queries=16).collect()
    want = brute([r for r in rows if r[0] is not None and r[0] < 9000])
    assert {r.query_id for r in got} == set(want) and recall(got, want) >= 0.9
    for q in (2000, 2880):
        assert sorted(r.vec_id for r in got if r.query_id == q) == sorted(j for j, _ in want[q])


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, "x", "y"), (1, [0.5], 1, "x", "y"), (2, [0.0, 2.0], 1, "x", "y")], SCHEMA)
    got = nearest_neighbours(few, F.col("vec_id") % 20 == 0)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert nearest_neighbours(few.filter("vec_id > 9"), F.col("vec_id") % 20 == 0).count() == 0


def test_parts_grow_with_the_rows():
    assert [parts_for(n) for n in (0, 100, 4096, 50_000, 200_000, 10**6, 10**9)] == [16, 16, 16, 16, 64, 256, 256]


def parts_made(vectors, parts=16):
    """How many parts a router has, and how many a query visits at least."""
    router = fit_router(np.array(vectors, float), parts)
    return router.weights[3].size, router.probes


@pytest.mark.parametrize(("kind", "most"), [("random", 16), ("clustered", 4)])
def test_recall_of_the_routed_search(spark, kind, most):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((2400, 16))
    if kind == "clustered":
        x = np.repeat(rng.standard_normal((24, 16)) * 4, 100, axis=0) + x * 0.3
    x = x.astype(np.float32).astype(float)
    made, probes = parts_made(x)
    assert made == 16 and probes <= most
    rows = list(enumerate(x.tolist()))
    vectors = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)
    got = nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, rows=500, queries=50).collect()
    assert recall(got, brute(rows)) >= 0.9
    assert len(got) == 120 * 20 and len({(r.query_id, r.vec_id) for r in got}) == len(got)


def test_small_tables_have_parts(spark, sf_dir):
    """The table of 500 vectors is cut, too: no scan of one part passes for a search."""
    x = np.array([r.embedding for r in table(spark, sf_dir, "embeddings").collect()], float)
    made, probes = parts_made(x, parts_for(len(x)))
    assert made >= 8 and probes < made


def test_repeated_ids_and_copies(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(700)] + [(7, rng.standard_normal(4).tolist()) for _ in range(5)] + [(1000 + i, [2.0, 2.0, 2.0, 2.0]) for i in range(600)]
    vectors = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)
    got = nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, rows=100, queries=10).collect()
    of = {r.query_id: [] for r in got}
    for r in sorted(got, key=lambda r: r["rank"]):
        of[r.query_id].append(r.vec_id)
    assert of[1000] == [i for i in range(1001, 1021)] and of[1020][:3] == [1000, 1001, 1002] and len(of) == 35 + 30
