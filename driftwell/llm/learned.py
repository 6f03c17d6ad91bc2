"""Approximate nearest neighbours by learned partitions.

1. A sample of at most SAMPLE vectors (the smallest draws of a hash of the ids) gives a neighbour graph: each
   vector and its NEIGHBOURS nearest by inner product.
2. The graph is cut into parts of equal size, as many as the table's rows ask for (``parts_for``), by recursive
   bisection: a spectral ordering is split at its
   median, then pairs of nodes change sides while that cuts fewer edges.
3. A small classifier (one hidden layer) learns to tell from a vector which parts its neighbours are in.
4. Every row of the table is indexed in its most probable part. A query visits its most probable parts: as many
   as give ``recall`` on the sample, where true neighbours are known, and as many more as it needs to meet k rows.
5. Rows of the visited parts are reranked by their inner products in double precision.

The sample bounds fitting alone, which the driver does; indexing and search are Spark jobs over all rows. The index is
written once and never moves: groups of about QUERIES queries, with the parts that they visit, are broadcast one after
the other, and each task keeps the k best of the rows that it reads. Of equal vectors in a batch only the k + 1 with the
smallest ids can be among them, so groups of copies cost nothing. A task holds a batch of ROWS rows and one group.

Defined results: rows with a null id or a null vector, or with a null, NaN or infinite component, and zero
vectors take no part; shorter vectors count as padded with zeros; equal scores go to the smaller id; a repeated
id is a row as often as it occurs, and no row is matched with a query of its own id; with fewer than k
candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bitslice import usable
from .common import digest_int, materialise, remove, shared_folder, ship

SAMPLE = 8192
NEIGHBOURS = 10
#: Rows that a part is to have, and the least and most parts: the sample has LEARNED vectors for each at least.
PART_ROWS = 4096
LEAST_PARTS, PARTS = 16, 256
LEARNED = 32
HIDDEN = 96
RECALL = 0.95
ROWS = 4096
QUERIES = 2048


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """near[row] = its k nearest other rows by inner product."""
    near = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        near[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return near


def _bisect(a: np.ndarray, b: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """One side of the nodes 0..n-1 of a graph of edges (a, b), both ways: half of them, with few edges across."""
    degree = np.bincount(a, minlength=n) + 1.0
    x = rng.standard_normal(n)
    for _ in range(60):
        x -= (x @ degree) / degree.sum()
        x = 0.5 * x + 0.5 * (np.bincount(a, weights=x[b], minlength=n) + x) / degree
        x /= np.linalg.norm(x) or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    for _ in range(12):
        other = np.bincount(a, weights=side[a] != side[b], minlength=n)
        gain = 2 * other - (degree - 1)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        worth = int((gain[left[:m]] + gain[right[:m]] > 0).sum()) // 2
        if not worth:
            break
        side[left[:worth]], side[right[:worth]] = True, False
    return side


def balanced_parts(near: np.ndarray, parts: int, seed: int = 1) -> np.ndarray:
    """The part of each node, parts of equal size (a power of two of them)."""
    rng, n = np.random.default_rng(seed), len(near)
    a = np.repeat(np.arange(n), near.shape[1])
    a, b = np.concatenate([a, near.reshape(-1)]), np.concatenate([near.reshape(-1), a])
    part, made = np.zeros(n, np.int64), 1
    while made < parts:
        new = part * 2
        for p in range(made):
            nodes = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            inside = (place[a] >= 0) & (place[b] >= 0)
            new[nodes[_bisect(place[a[inside]], place[b[inside]], len(nodes), rng)]] += 1
        part, made = new, made * 2
    return part


class Router:
    """A classifier with one hidden layer: the probability of each part, from a vector."""

    def __init__(self, dims: int, hidden: int, parts: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.weights = [rng.standard_normal((dims, hidden)) / np.sqrt(dims), np.zeros(hidden), rng.standard_normal((hidden, parts)) / np.sqrt(hidden), np.zeros(parts)]
        self.scale, self.probes = 1.0, 1

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.weights
        z = np.maximum(x * self.scale @ w + b, 0) @ v + c
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def learn(self, x: np.ndarray, target: np.ndarray, epochs: int = 25, batch: int = 256, rate: float = 3e-3, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.scale = np.sqrt(x.shape[1]) / (np.linalg.norm(x, axis=1).mean() or 1.0)
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                some = order[at : at + batch]
                w, b, v, c = self.weights
                inner = x[some] * self.scale
                h = np.maximum(inner @ w + b, 0)
                z = h @ v + c
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d = (p - target[some]) / len(some)
                back = (d @ v.T) * (h > 0)
                step += 1
                for i, g in enumerate([inner.T @ back, back.sum(0), h.T @ d, d.sum(0)]):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.weights[i] = self.weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-9)


def fit_router(x: np.ndarray, parts: int = 16, neighbours: int = NEIGHBOURS, k: int = 20, recall: float = RECALL) -> Router:
    """A router with as many probes as find ``recall`` of a sample vector's k nearest in the sample."""
    x = np.unique(x, axis=0)
    while parts > 1 and len(x) < LEARNED * parts:
        parts //= 2
    if parts == 1:
        return Router(max(x.shape[1], 1), 1, 1)
    near = neighbour_graph(x, max(neighbours, k))
    part = balanced_parts(near[:, :neighbours], parts)
    target = np.zeros((len(x), parts))
    for column in [part, *part[near[:, :neighbours]].T]:
        target[np.arange(len(x)), column] += 1
    router = Router(x.shape[1], HIDDEN, parts)
    router.learn(x, target / target.sum(axis=1, keepdims=True))
    p = router.probabilities(x)
    place = np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1)
    visited = np.take_along_axis(place, p.argmax(axis=1)[near[:, :k]], axis=1)
    found = [(visited < m).mean() for m in range(1, parts + 1)]
    router.probes = next(m for m, f in enumerate(found, 1) if f >= min(recall, found[-1]))
    return router


def parts_for(rows: int) -> int:
    """A power of two that grows with the table, so that a part has about PART_ROWS rows, from LEAST_PARTS up to PARTS parts.

    A table with fewer than LEARNED different vectors for each of so many parts has half as many, and so on.
    """
    return min(max(1 << max(round(math.log2(max(rows, 1) / PART_ROWS)), 0), LEAST_PARTS), PARTS)


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (query, id, score) columns the k best of each query: greatest scores, then smallest ids."""
    query, ids, score = found
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    keep = place < k
    return [query[keep], ids[keep], score[keep]]


def _rerank(group: Callable[[], tuple], dims: int, k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each task's k best rows of its part of the index, for a group of queries (number, id, vector, parts)."""

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, query_id, q, visits = group()
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        least = np.full(len(number), -np.inf)  # what a score must reach to be among a query's best so far
        for batch in batches:
            every, parts, vectors = batch["_id"].to_numpy(), batch["_part"].to_numpy(), _matrix(batch["_v"], dims)
            for p in np.unique(parts):
                asking = np.flatnonzero(visits[:, p])
                mine = np.flatnonzero(parts == p)
                mine = mine[np.argsort(every[mine], kind="stable")]
                if not len(asking) or not len(mine):
                    continue
                _, copy = np.unique(vectors[mine], axis=0, return_inverse=True)
                order = np.argsort(copy.reshape(-1), kind="stable")
                sizes = np.bincount(copy.reshape(-1))
                nth = np.empty(len(mine), np.int64)
                nth[order] = np.arange(len(mine)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                # rows of the query's own id don't count, so ids rather than rows are counted where they repeat
                mine = mine[nth <= k] if len(np.unique(every[mine])) == len(mine) else mine
                ids, x = every[mine], vectors[mine]
                s = q[asking] @ x.T
                s[query_id[asking][:, None] == ids[None, :]] = -np.inf
                floor = least[asking]
                if len(ids) > k:
                    floor = np.maximum(floor, np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k])
                with np.errstate(invalid="ignore"):
                    near = (s >= np.where(np.isfinite(floor), floor - 1e-9 * (1 + np.abs(floor)), -np.inf)[:, None]) & (s > -np.inf)
                at, row = np.nonzero(near)
                # Summed row by row, so that equal vectors score alike wherever they stand.
                exact = (x[row] * q[asking[at]]).sum(axis=1)
                found = _best([np.concatenate(c) for c in zip(found, (asking[at], ids[row], exact))], k)
                held, counts = np.unique(found[0], return_counts=True)
                last = np.cumsum(counts) - 1
                least[held[counts == k]] = found[2][last[counts == k]]
        yield pd.DataFrame({"_q": number[found[0]], "query_id": query_id[found[0]], "vec_id": found[1], "score": found[2]})

    return rerank


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, parts: int | None = None, sample: int = SAMPLE, recall: float = RECALL, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found rows of ``vectors`` (vec_id, embedding)."""
    v = F.col("embedding").cast("array<double>")
    whole = vectors.filter(F.col("vec_id").isNotNull() & usable(v) & F.exists(v, lambda x: x != 0)).select(
        F.col("vec_id").cast("long").alias("_id"), v.alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_asks")
    )
    n, dims = whole.agg(F.count("*"), F.max(F.size("_v"))).first()
    dims = dims or 1
    parts = parts or parts_for(n)
    draw = digest_int(F.concat(F.lit("sample:"), F.col("_id").cast("string")))
    drawn = whole.withColumn("_draw", draw).filter(F.col("_draw") <= int(min(1.0, 1.2 * sample / max(n, 1)) * (1 << 52)))
    fitted = drawn.orderBy("_draw", "_id").limit(sample).select("_v").toPandas()
    router = fit_router(_matrix(fitted["_v"], dims), parts, k=k, recall=recall)
    model = ship(vectors.sparkSession, router)

    @F.pandas_udf("int")
    def part_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model()
        for v in batches:
            yield pd.Series(own.probabilities(_matrix(v, dims)).argmax(axis=1).astype(np.int32))

    # The index: every row with its part. Row numbers of a written table don't change when a task runs again.
    index = materialise(whole.withColumn("_part", part_of("_v")).sortWithinPartitions("_part")).withColumn("_n", F.monotonically_increasing_id())
    held = {r["_part"]: r["n"] for r in index.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    sizes = np.array([held.get(p, 0) for p in range(router.weights[3].size)])

    @F.pandas_udf("array<int>")
    def parts_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model()
        for v in batches:
            order = np.argsort(-own.probabilities(_matrix(v, dims)), axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) <= k).sum(axis=1) + 1
            yield pd.Series([o[: max(own.probes, m)].astype(np.int32) for o, m in zip(order, enough, strict=True)])

    count = index.filter("_asks").count()
    groups = -(-count // queries)
    asked = materialise(index.filter("_asks").select("_id", "_v", F.col("_n").alias("_q"), parts_of("_v").alias("_parts"), F.pmod(F.xxhash64("_n"), F.lit(max(groups, 1))).alias("_group")))
    spark, folder = vectors.sparkSession, f"{shared_folder(vectors.sparkSession)}/ann-{uuid.uuid4().hex}"
    # as many rows as a batch may have, put back afterwards
    setting, former = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(setting, rows)
    try:
        for g in range(groups):
            some = asked.filter(F.col("_group") == g).drop("_group").toPandas()  # about ``queries`` rows, whatever the table
            visits = np.zeros((len(some), len(sizes)), bool)
            for i, own in enumerate(some["_parts"]):
                visits[i, np.asarray(own, int)] = True
            group = ship(spark, (some["_q"].to_numpy(np.int64), some["_id"].to_numpy(np.int64), _matrix(some["_v"], dims), visits))
            index.select("_id", "_v", "_part").mapInPandas(_rerank(group, dims, k), "_q long, query_id long, vec_id long, score double").write.mode("append").parquet(folder)
    finally:
        spark.conf.set(setting, former)
    if not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("_q").orderBy(F.col("score").desc(), "vec_id")
    found = spark.read.parquet(folder).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out = materialise(found.select("query_id", "rank", "vec_id", "score"))
    remove(spark, folder)
    return out
