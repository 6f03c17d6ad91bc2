from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from driftwell.llm.periodic import collapse, find_runs, periodic_runs, regions, last_seen
from driftwell.llm.q_periodic import SQL, op12_periodic_runs, with_repeats


def slow_runs(words, least=6, times=4):
    """Every period is tried at every place."""
    n, best = len(words), {}
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - (i - q) >= max(least, times * q):
                best.setdefault((i - q, j), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        words = [str(rng.randrange(rng.choice([1, 2, 3, 10]))).encode() for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            unit = [str(rng.randrange(5)).encode() for _ in range(rng.randrange(1, 12))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * 6)[: rng.randrange(1, 6 * len(unit) + 1)]
        yield words


def test_runs_are_those_of_brute_force():
    found = 0
    for words in texts(1, 2000):
        want = slow_runs(words)
        assert find_runs(words) == want
        found += len(want)
    assert found > 500


@pytest.mark.parametrize(("least", "times"), [(1, 4), (20, 4), (6, 7)])
def test_other_bounds(least, times):
    for words in texts(2, 400):
        assert find_runs(words, least, times) == slow_runs(words, least, times)
    with pytest.raises(ValueError):
        find_runs([b"a"] * 9, times=3)


def test_long_periods_and_long_texts():
    unit = [str(i).encode() for i in range(1000)]
    prose = [f"x{i}".encode() for i in range(500)]
    assert find_runs(prose + unit * 4 + prose) == [(500, 4000, 1000)]
    assert find_runs(prose + (unit * 4)[:-1] + prose) == []
    assert find_runs([b"a"] * 50_000) == [(0, 50_000, 1)]
    assert find_runs(([b"a"] * 99 + [b"b"]) * 4) == [(0, 99, 1), (0, 400, 100), (100, 99, 1), (200, 99, 1), (300, 99, 1)]


def test_prose_leaves_no_region():
    assert regions(last_seen("the cat and the dog and the bird".encode().split())) == []


def test_first_period_stays():
    words = b"a b c d c d c d c d e".split()
    assert collapse(words, find_runs(words)) == b"a b c d e"


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, " \t\n", "x"), (4, "a b a", "x"), (4, "w " * 7, "x"), (4, "w " * 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()))
    assert got == [(0, 0, [], ""), (1, 0, [], ""), (2, 0, [], ""), (4, 2, [], "a b a"), (4, 7, [(0, 7, 1)], "w"), (4, 7, [(0, 7, 1)], "w")]
    assert periodic_runs(docs.filter("false")).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op12_periodic_runs(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    planted = 0
    for doc_id, text in docs.items():
        words = text.encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = slow_runs(words) if n < 3000 else find_runs(words)
        planted += h % 10 == 0 and bool(runs)
        r = got[doc_id]
        top = min(((-length, s, q) for s, length, q in runs), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *((top[1], -top[0], top[2]) if top else (None, None, None)))
        assert r.exponent_milli == (1000 * -top[0] // top[2] if top else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert planted


def test_sql_gives_the_same(spark, sf_dir, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b " * 9), (4, "x " * 5), (5, "x " * 6), (34, "p q r s t u v w " * 3), (None, "z " * 8)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(SQL)
    names = [c[0] for c in want.description]
    got = op12_periodic_runs(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_null_ids_get_no_tail(spark):
    docs = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert with_repeats(docs).filter(F.col("text") == "a b c d").count() == 1
