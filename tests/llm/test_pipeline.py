from __future__ import annotations

from collections import Counter

import corpus_pipeline
from driftwell.llm.common import table


def test_stages_take_effect(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "language ID", "SimHash near-dedup", "mixing sources", "packing"]
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, sf_dir).collect(), docs.schema)
        assert kept.columns == docs.columns
        seen[name] = kept.collect()
    good = {r.doc_id for r in table(spark, sf_dir, "labels").filter("quality = 1").collect()}
    assert len({r.doc_id for r in seen["language ID"]} & good) >= 0.95 * len(good)
    texts = Counter(r.text for r in seen["SimHash near-dedup"])
    assert max(texts.values()) == 1 and set(texts) <= {r.text for r in seen["language ID"]}
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in seen["mixing sources"]}


def test_language_stage_rejects_the_undecided(spark):
    rows = [(i, "the quick brown fox and the lazy dog " * 3, "en", "s", 1) for i in range(30)] + [(50 + i, "der schnelle braune fuchs und der faule hund " * 3, "de", "s", 1) for i in range(30)]
    rows += [(100, "12345 %%%", "en", "s", 1), (101, None, "en", "s", 1), (102, "the quick brown fox and the lazy dog", "de", "s", 1), (103, "der faule hund", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()}
    assert {r[0] for r in rows[:60]} | {103} <= kept and not kept & {100, 101, 102}


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    """Nulls in any column, repeats, long and empty texts, clashing column names; then no rows at all."""
    words = ["alpha", "beta", "gamma", "delta", "sun", "moon", "river", "stone"]
    text = lambda i: " ".join(words[(i * 7 + j * (i + 3)) % 8] + str((i * j) % 5 or "") for j in range(40))
    rows = [(i, text(i), "en" if i % 9 else None, f"s{i % 3}" if i % 5 else None, 99 if i % 4 else None) for i in range(80)]
    rows += [(None, text(200), "en", "s1", 5), (3, text(3), "en", "s0", 99), (3, text(3), "en", "s0", 99), (90, None, "en", "s1", 0), (91, "", None, None, None), (92, " \n ", "en", "s1", 2), (93, "word salad and more " * 20_000, "en", "s2", 7), (94, text(5), "en", "s2", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score string, keep int, lang_pred string, _id long, _draw int, component string, _mark int, size int, taken string, _key string, start int"
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2, 3, "c", 4, 5, "t", "k", 6) for r in rows], names)
    folder = str(tmp_path)
    spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{n}")
        kept = spark.read.parquet(f"{folder}/{n}")
        assert n == 4 or kept.columns == docs.columns, name
        assert kept.count() > 20, name
        if n == 0:
            assert not kept.filter("doc_id in (90, 91, 92)").count()
        if n == 2:
            assert kept.filter("doc_id = 3").count() == 1 and not kept.filter("doc_id = 94").count()
        empty = stage(spark, docs.limit(0), folder)
        assert empty.count() == 0, name
        docs = kept
