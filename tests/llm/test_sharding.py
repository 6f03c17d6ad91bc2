from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from driftwell.llm.common import table
from driftwell.llm.q_sharding import SQL, op3_sharding
from driftwell.llm.sharding import Topology, shard_documents, shard_of


def test_as_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({SQL})").fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in op3_sharding(spark, sf_dir).collect()) == want


def test_slots_sizes_and_growth(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, sf_dir, "documents").collect()}
    slots = defaultdict(list)
    for r in op3_sharding(spark, sf_dir).collect():
        assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shares_follow_weights_and_moves_stay_in_changed_subtrees(spark):
    before = Topology(((((0, 1.0), (1, 1.0)), ((2, 2.0),)), (((3, 4.0),),)))
    after = Topology(((((0, 1.0), (1, 3.0)), ((2, 2.0),)), (((3, 4.0),),)))
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    rows = keys.select(shard_of(F.col("k"), before).alias("a"), shard_of(F.col("k"), after).alias("b")).collect()
    share = Counter(r.a for r in rows)
    assert all(abs(share[s] / 20_000 - w / 8) < 0.02 for s, w in enumerate([1, 1, 2, 4]))
    # Region 0, its rack 0 and its shard 1 grow: keys enter the region anywhere, then the rack, then the shard.
    assert {(r.a, r.b) for r in rows if r.a != r.b} <= {(3, 0), (3, 1), (3, 2), (2, 0), (2, 1), (0, 1)}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "é" * 100_000, 3)], "doc_id long, text string, slot int")
    got = sorted((str(r.doc_id), r.size) for r in shard_documents(docs).collect())
    assert got == [("1", 1), ("1", 1), ("2", 200_001), ("None", 1)]
    assert shard_documents(docs.filter("doc_id > 9")).count() == 0


def test_one_more_shard_takes_rows_only_into_itself(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    for shards in (1, 3, 6, 7, 8):
        rows = shard_documents(docs, shards).collect()
        assert {r.grown_shard for r in rows if r.grown_shard != r.shard} == {shards}
        share = sum(r.grown_shard == shards for r in rows) / len(rows)
        assert abs(share - 1 / (shards + 1)) < 0.03


def test_rows_without_ids_meet_in_many_chunks(spark):
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "repeat('t', cast(id % 700 as int)) as text")
    rows = shard_documents(docs).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(3000))
    ends = {}
    for r in rows:
        ends.setdefault((r.size, r.text_crc32), []).append(r.slot)
    assert all(max(s) - min(s) == len(s) - 1 for s in ends.values())  # equal rows stand together, so chunks go by text
    order = [r.size for r in sorted(rows, key=lambda r: r.slot)]
    assert order != sorted(order)
