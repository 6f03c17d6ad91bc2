"""Periodic runs of words: aligned blocks of power-of-two length are looked up over the text, hits seed exact extension.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least ``least`` words and
``times`` periods. ``times`` is 4 or more: then a run with a period in [B, 2B), B a power of two, holds an aligned block
of B words (at a multiple of B) together with its copy one period later. So for each scale B the aligned blocks go into
an Aho-Corasick automaton, one pass over the text yields their occurrences, and an occurrence at a distance in [B, 2B)
from its block seeds a run, which is extended word by word to both sides. From 8 words on a block's key is the numbers of
its four quarters (equal numbers, equal words), since in periodic text an automaton over single words would walk one
failure link after the other at each word. Nothing is sampled, hashed or capped: runs are exact.

Before that, regions without runs are left out: each word of a run, but those of its first period, has occurred within
the period before it. Words whose last occurrence is further back than a share of the stretch that they stand in can't
be in a run; taking them out shortens stretches, until nothing changes. Ordinary prose vanishes in a few rounds.

Every document is judged on its own in the task that reads it, so nothing is shuffled, and no source, text or group of
copies can be hot. Memory is that of a batch of rows (``common.TEXT_ROWS``) plus some 150 bytes a word of one document.

Odd rows: null and empty texts have no words, no runs and an empty collapsed text. Null and repeated ids are carried as
they are. Columns beside id and text are not read, so their names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_batches

#: Least words and least periods of a run.
LEAST, TIMES = 6, 4


def last_seen(words: list[bytes]) -> np.ndarray:
    """How far back each word last occurred; 0 if it didn't."""
    at: dict[bytes, int] = {}
    back = []
    for i, w in enumerate(words):
        back.append(i - at.get(w, i))
        at[w] = i
    return np.array(back, np.int64)


def regions(back: np.ndarray, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, end, largest period) of the parts of a text outside of which no run is."""
    stretch = np.flatnonzero(back)
    while stretch.size:
        cut = np.flatnonzero(np.diff(stretch) > 1) + 1
        bounds = np.concatenate(([0], cut, [stretch.size]))
        long = np.repeat(np.diff(bounds), np.diff(bounds))
        keep = back[stretch] * (times - 1) <= long
        if keep.all():
            starts, ends = stretch[bounds[:-1]], stretch[bounds[1:] - 1] + 1
            most = (ends - starts) // (times - 1)
            return list(zip(np.maximum(starts - most, 0).tolist(), ends.tolist(), most.tolist()))
        stretch = stretch[keep]
    return []


def _forward(codes: np.ndarray, i: int, d: int) -> int:
    """The first place from ``i`` on whose word differs from the one ``d`` before it."""
    step = 64
    while i < codes.size:
        end = min(i + step, codes.size)
        odd = np.flatnonzero(codes[i:end] != codes[i - d : end - d])
        if odd.size:
            return i + int(odd[0])
        i, step = end, step * 2
    return codes.size


def _backward(codes: np.ndarray, i: int, d: int) -> int:
    """The smallest place such that all words from it to before ``i`` equal those ``d`` after them."""
    step = 64
    while i > 0:
        low = max(0, i - step)
        odd = np.flatnonzero(codes[low:i] != codes[low + d : i + d])
        if odd.size:
            return low + int(odd[-1]) + 1
        i, step = low, step * 2
    return 0


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers from 1 for pairs of numbers, equal for equal pairs."""
    return pd.factorize(first * (int(second.max(initial=0)) + 1) + second)[0] + 1


def _search(codes: np.ndarray, most: int, least: int, times: int) -> dict[tuple[int, int], int]:
    """(start, end) of each run in a region with its smallest period."""
    found: dict[tuple[int, int], int] = {}
    n, names, part, size = codes.size, codes, 1, 1
    reach = [(0, 0, 1)] * n  # for each place the run found so far that reaches furthest
    while size <= most:
        if size >= 8:  # a block is four names of its quarters, so that the automaton is four deep at any scale
            names, part = _pairs(names[:-part], names[part:]), part * 2
        rows, keys = -(-names.size // part) + 1, size // part
        # the names at each distance of ``part`` from one another, one such sequence after the other, each ended by 0
        lanes = np.zeros(rows * part, np.int64)
        lanes[: names.size] = names
        lanes = lanes.reshape(rows, part).T.ravel().tolist()
        blocks, block = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), []
        for j in range(n // size):
            key = tuple(lanes[j * keys : (j + 1) * keys])
            block.append(blocks.get(key, j))
            if block[j] == j:
                blocks.add_word(key, j)
        blocks.make_automaton()
        tried: dict[int, int] = {}  # by distance; hits at one distance come in order
        fresh = []
        for last, known in blocks.iter(tuple(lanes)):
            lane, row = divmod(last - keys + 1, rows)
            x = row * part + lane
            j = x // size - 1  # the one aligned block whose distance is in [size, 2 * size)
            if j < 0 or block[j] != known:
                continue
            p, end = j * size, x + size
            d = x - p
            if d > most or tried.get(d, 0) >= end:
                continue
            s, e, q = reach[p]
            if e >= end and d % q == 0:
                continue
            s, e = _backward(codes, p, d), _forward(codes, end, d)
            tried[d] = e
            if e - s >= max(least, times * d) and found.get((s, e), d) >= d:
                found[s, e] = d
                fresh.append((s, e, d))
        for s, e, d in fresh:
            for i in range(s, e):
                if reach[i][1] < e:
                    reach[i] = (s, e, d)
        size *= 2
    return found


def find_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start, then period."""
    if times < 4:
        raise ValueError("aligned blocks find runs of four periods or more")
    runs: dict[tuple[int, int], int] = {}
    for low, high, most in regions(last_seen(words), times):
        numbers: dict[bytes, int] = {}
        codes = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words[low:high]], np.int64)
        for (s, e), q in _search(codes, most, least, times).items():
            s, e = low + s, low + e
            # a run that goes on beyond this region lies whole in another one
            if not (s == low > 0 and words[s - 1] == words[s - 1 + q] or e == high < len(words) and words[e] == words[e - q]):
                runs[s, e] = q
    return sorted(((s, e - s, q) for (s, e), q in runs.items()), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stay when each run is cut down to its first period, joined by a space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``key``, ``n_words``, ``runs`` (start, length, period) and ``collapsed`` text of every document.

    Texts travel as bytes, so that what is no valid UTF-8 stays as it is.
    """
    text_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, runs, collapsed = [], [], []
            for value in batch.column(1):
                words = (value.as_py() or b"").split()  # at the six white-space characters of ASCII, those of the contract
                found = find_runs(words, least, times)
                n.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                collapsed.append(collapse(words, found))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(collapsed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "runs", "collapsed"])

    asked = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    told = asked.mapInArrow(judge, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return told.select(F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
