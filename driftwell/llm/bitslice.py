"""Exact top-k inner products by a bit-sliced index.

1. Every component x becomes floor(scale * x), a whole number. Rows are dealt to blocks of about ROWS rows.
   A block keeps, for each component, one bitmap per bit of the number (biased so that it isn't negative).
   Those bitmaps are the index; a block of it is one row.
2. A query adds the slices of the components, each as often as its own number says, by bitmap arithmetic: one
   shifted addition for each set bit of its number. Sums are held in carry-save form (two bitmaps a bit) until
   the end, so that an addition costs a few whole-bitmap operations and no ripple. Negative numbers add the
   complement; what bias and complements add is the same for every row and is taken off at the end.
3. From the most significant slice of the sum downward, rows with a 1 are taken while they're at most k; else
   the choice narrows to them. Rows that still tie with the k-th after the last slice are boundary rows: they
   have one score, and those with the smallest ids fill up the rest, exactly.
4. A block returns at most k rows a query, and the best k over all blocks are the result.

Queries meet every block ("a stated query set against all rows, in blocks"): a task holds one block at a time, and
queries pass it as a stream, so blocks are never copied and no number of queries fills a task's memory.

Numbers may be of any size: a block has as many slices as its largest component needs, and sums are whole numbers
without a limit. Only a score that is returned must fit into a long; if one doesn't, the query fails and says so.

Defined results: rows with a null id or a null vector, or with a null, NaN or infinite component, take no part;
shorter vectors (empty ones too) count as padded with zeros; equal scores go to the smaller id; a repeated id is a row
as often as it occurs, and no row is matched with a query of its own id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise

SCALE = 1024
ROWS = 8192
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _floor(x: Column) -> Column:
    """As a double: those of 2**52 and more are whole numbers already, and may be beyond a long."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def pack_slices(values: np.ndarray, bits: int) -> np.ndarray:
    """values[row, component] -> bitmaps[component, bit, word] of values + 2**(bits - 1)."""
    rows, dims = values.shape
    wide = bits > 62  # such numbers are Python's own
    biased = (values.astype(object) if wide else values).T + (1 << (bits - 1))
    out = np.zeros((dims, bits, (rows + 63) // 64 * 8), np.uint8)
    for b in range(bits):
        ones = ((biased >> b) & 1).astype(np.uint8)
        packed = np.packbits(ones, axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return out.view(np.uint64)


def add_weighted(slices: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, int]:
    """Slices of the sum of query[j] * component j, less a constant: (bitmaps[bit, word], what to add to it)."""
    dims, bits, words = slices.shape
    bias, top = 1 << (bits - 1), (1 << bits) - 1
    query = [int(q) for q in query]
    width = max(1, (sum(abs(q) for q in query) * top).bit_length()) + 1
    s, c = np.zeros((width, words), np.uint64), np.zeros((width + 1, words), np.uint64)
    offset = 0
    for j, q in enumerate(query):
        if not q:
            continue
        x = slices[j] if q > 0 else ~slices[j]
        offset += -q * bias if q > 0 else -q * (bias - top)
        m = abs(q)
        for k in range(m.bit_length()):
            if not m >> k & 1:
                continue
            low, high = slice(k, k + bits), slice(k + bits, width)
            # Full adders where the addend has slices, half adders above, so that each bit again has two bitmaps.
            both, either = s[low] & c[low], s[low] ^ c[low]
            up, half = s[high] & c[high], s[high] ^ c[high]
            c[k + 1 : k + bits + 1] = both | (either & x)
            c[k + bits + 1 : width + 1] = up
            c[k] = 0
            s[low] = either ^ x
            s[high] = half
    carry = np.zeros(words, np.uint64)
    for b in range(width):
        half = s[b] ^ c[b]
        both = s[b] & c[b]
        s[b] = half ^ carry
        carry = both | (half & carry)
    return s, offset


def select_top(total: np.ndarray, alive: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k rows of ``alive`` with the greatest sums; among boundary rows those that come first."""
    sure, maybe = np.zeros_like(alive), alive.copy()
    if int(np.bitwise_count(maybe).sum()) > k:
        for b in range(total.shape[0] - 1, -1, -1):
            ones = maybe & total[b]
            n = int(np.bitwise_count(sure | ones).sum())
            if n > k:
                maybe = ones
            else:
                sure |= ones
                maybe &= ~total[b]
                if n == k:
                    maybe[:] = 0
                    break
    taken = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    rest = np.flatnonzero(np.unpackbits(maybe.view(np.uint8), bitorder="little"))[: k - len(taken)]
    return np.concatenate([taken, rest])


def read_sums(total: np.ndarray, at: np.ndarray, offset: int) -> list[int]:
    bits = (total[:, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
    return [sum(int(v) << b for b, v in enumerate(col) if v) + offset for col in bits.T]


def search_block(slices: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int) -> list[tuple[int, int]]:
    """(id, score) of the block's k best rows for one query; ``ids`` ascends."""
    alive = np.full(slices.shape[2], ALL)
    if tail := len(ids) % 64:
        alive[-1] = np.uint64((1 << tail) - 1)
    for p in range(*np.searchsorted(ids, [query_id, query_id + 1])):
        alive[p >> 6] &= ~np.uint64(1 << (p & 63))
    total, offset = add_weighted(slices, query)
    at = select_top(total, alive, k)
    return list(zip(ids[at].tolist(), read_sums(total, at, offset), strict=True))


def whole_numbers(v: np.ndarray, dims: int) -> list[int]:
    """Doubles without a fraction as whole numbers of any size, padded with zeros."""
    return [int(x) for x in v] + [0] * (dims - len(v))


def _pack(dims: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)  # one block of about ROWS rows
        rows = pd.concat(parts) if parts else pd.DataFrame()
        if len(rows):
            rows = rows.sort_values("_id", kind="stable")
            top = max((float(np.abs(v).max()) for v in rows["_v"] if len(v)), default=0.0)
            bits = int(top).bit_length() + 1
            values = np.zeros((len(rows), dims), object if bits > 62 else np.int64)
            for i, v in enumerate(rows["_v"]):
                values[i, : len(v)] = [int(x) for x in v] if bits > 62 else v
            yield pd.DataFrame({"_block": [int(rows["_at"].iloc[0])], "_bits": [bits], "_ids": [rows["_id"].to_numpy(np.int64).tobytes()], "_slices": [pack_slices(values, bits).tobytes()]})

    return pack


FOUND = "_q long, query_id long, vec_id long, score long"


def _search(dims: int, k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by block, a block's slices before its queries."""
        ids, slices = np.zeros(0, np.int64), np.zeros((dims, 1, 0), np.uint64)
        for rows in batches:
            found = []
            for bits, own, data, key, query_id, v in rows[["_bits", "_ids", "_slices", "_q", "_id", "_v"]].itertuples(index=False, name=None):
                if data is not None:
                    ids, slices = np.frombuffer(own, np.int64), np.frombuffer(data, np.uint64).reshape(dims, int(bits), -1)
                    continue
                for i, score in search_block(slices, ids, whole_numbers(v, dims), int(query_id), k):
                    if not -(1 << 63) <= score < 1 << 63:
                        raise OverflowError(f"the score of vectors {int(query_id)} and {i} doesn't fit into a long")
                    found.append((int(key), int(query_id), i, score))
            yield pd.DataFrame(found, columns=["_q", "query_id", "vec_id", "score"], dtype="int64")

    return search


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, rows: int = ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k rows of ``vectors`` (vec_id, embedding) with the greatest scores."""
    v = F.col("embedding").cast("array<double>")
    # Whole numbers stay doubles, which hold them exactly, until a task reads them.
    whole = vectors.filter(F.col("vec_id").isNotNull() & usable(v)).select(
        F.col("vec_id").cast("long").alias("_id"), F.transform(v, lambda x: _floor(F.lit(float(scale)) * x)).alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_asks")
    )
    n, dims = whole.agg(F.count("*"), F.max(F.size("_v"))).first()
    dims, blocks = max(dims or 0, 1), max(1, -(-n // rows))
    dealt = whole.select("_id", "_v").repartition(blocks).withColumn("_at", F.spark_partition_id())
    index = materialise(dealt.mapInPandas(_pack(dims), "_block int, _bits int, _ids binary, _slices binary"))
    asked = materialise(whole.filter("_asks").select("_id", "_v", F.monotonically_increasing_id().alias("_q")))

    none = lambda kind: F.lit(None).cast(kind)
    left = index.select("_block", "_bits", "_ids", "_slices", none("long").alias("_q"), none("long").alias("_id"), none("array<double>").alias("_v"))
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), none("int"), none("binary"), none("binary"), "_q", "_id", "_v")
    met = left.unionAll(right).repartition(blocks, "_block").sortWithinPartitions("_block", F.col("_q").asc_nulls_first())
    found = met.mapInPandas(_search(dims, k), FOUND)
    best = Window.partitionBy("_q").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
