from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from driftwell.llm.common import table
from driftwell.llm.mixing import _mix, apportion, mix_documents, mix_texts, source_targets
from driftwell.llm.q_mixing import SQL, op4_mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, taken string, _n int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_as_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = {r[0]: r for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({SQL})").fetchall()}
    got = op4_mixing(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.size, r.source_size, r.taken) == (w[1], w[2], w[4]) and abs(r.target - w[3]) < 1e-6 * max(1, w[3])


def test_every_document_and_targets_near(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    sizes = {r.doc_id: (r.source, len(WORDS.findall(r.text or ""))) for r in docs.collect()}
    got = mix_documents(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(sizes)
    taken, target = Counter(), {}
    for r in got:
        assert r.size == sizes[r.doc_id][1] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(n for _, n in sizes.values())) < 1
    assert all(abs(taken[s] - t) <= 0.01 * t + 200 for s, t in target.items())


def test_targets_stop_at_caps(spark):
    rows = [("a", 10), ("b", 1000), ("c", 300), (None, 50)]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    assert got["a"] == 20 and got[None] == 100 and got["c"] == 600 and abs(sum(got.values()) - 2040) < 1e-6


def test_highest_quotients(spark):
    parties = [("g", i, float(v), 25, 9) for i, v in enumerate([53, 24, 23, 7, 1])]
    df = spark.createDataFrame(parties, "g string, party int, votes double, seats long, cap long")
    seats, votes = Counter(), [53, 24, 23, 7, 1]
    for _ in range(25):
        seats[max((i for i in range(5) if seats[i] < 9), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))] += 1
    assert {r.party: r.quota for r in apportion(df, ["g"], ["party"], "votes", "seats", "cap").collect()} == {i: seats[i] for i in range(5)}


def test_texts_have_the_taken_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    whole = {r.doc_id: r.text for r in docs.collect()}
    taken = {r.doc_id: r.taken for r in mix_documents(docs).collect()}
    mixed = defaultdict(list)
    for r in mix_texts(docs).collect():
        mixed[r.doc_id].append(r.text)
        assert r.n_chars == len(r.text)
    for i, n in taken.items():
        assert sum(len(WORDS.findall(t)) for t in mixed[i]) == n and len(mixed[i]) <= 2
        for t in mixed[i]:
            assert t == whole[i] or not Counter(WORDS.findall(t)) - Counter(WORDS.findall(whole[i]))


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z", None), (None, "p q", "b"), (4, "w " * 100_000, "b"), (5, "twice here", "c"), (5, "twice here", "c"), (5, "other", "c")]
    docs = spark.createDataFrame([(i, t, "en", s, 0, "clash", 1) for i, t, s in rows], SCHEMA)
    got = mix_documents(docs).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len((t or "").split())) for i, t, _ in rows)
    assert all(r.taken <= 2 * r.size for r in got)
    texts = mix_texts(docs)
    assert texts.columns == docs.columns
    assert sum(len(r.text.split()) for r in texts.collect()) == sum(r.taken for r in got)
    assert mix_documents(docs.filter(F.lit(False))).count() == 0 and mix_texts(docs.filter(F.lit(False))).count() == 0


def test_rows_without_ids_spread_over_shards_as_in_sql(spark, tmp_path):
    """Nine in ten ids are null, many rows alike: the same as SQL, and more shards than one."""
    rows = [(i if i % 10 == 0 else None, " ".join(["w"] * (50 + i % 40 + 7 * (i % 3))) + f" {i % 300}", "en", "a" if i % 3 else None, 0, "clash", 1) for i in range(1200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    placed, _ = _mix(docs, 1.5, 2, 64, 8192)
    assert placed.filter("doc_id is null and source = 'a'").select("_shard").distinct().count() > 3
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = Counter(con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({SQL})").fetchall())
    got = Counter((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mix_documents(docs).collect())
    totals = lambda c: (sum(c.values()), sum(k[4] * n for k, n in c.items()))
    assert totals(got) == totals(want) and {k: n for k, n in got.items() if k[0] is not None} == {k: n for k, n in want.items() if k[0] is not None}
