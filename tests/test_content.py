"""What depends on blobs alone is worked out once for each pair of blobs, whatever the number of commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.operators import chain

TEXTS = [("x", "a: 1\nb: 2\n"), ("y", "a: 3\nb: 2\n"), ("z", "c: 1\n")]
FILES = [(f"c{i}", "f.yml", "x", "y") for i in range(30)] + [
    ("c1", "g.yml", "y", "z"), ("c2", "g.yml", None, "z"), ("c3", "g.yml", "x", None), ("c4", "g.yml", "z", "z"), ("c5", "g.yml", "x", "lost"),
    # listed more than once: alike, and with different versions
    ("c6", "g.yml", "x", "y"), ("c6", "g.yml", "x", "y"), ("c7", "g.yml", "x", "y"), ("c7", "g.yml", "z", "x"),
]


def given(spark):
    files = spark.createDataFrame(FILES, "commit_hash string, file_path string, previous_file_hash string, file_hash string").withColumn("repository", F.lit("r"))
    return files, chain.parsed(spark.createDataFrame(TEXTS, "file_hash string, text string"))


def test_work_sees_a_pair_once_and_files_listed_twice_as_they_are(spark):
    files, seen = given(spark)[0], []
    found = chain.by_content(files, chain.FILE, chain.PAIR, lambda rows, by: seen.append(rows.count()) or rows.groupBy(*by).agg(F.count("*").alias("n")))
    assert seen == [6, 4]
    assert found.groupBy("n").count().sort("n").collect() == [(1, 35), (2, 2)]


def test_changes_and_templates_are_those_of_every_file_by_itself(spark):
    files, nodes = given(spark)
    plain, got = chain._changes(files, nodes, chain.FILE), chain.document_changes(files, nodes)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.select(got.columns).collect()))
    clean = files.select(*chain.COMMIT, F.array(F.lit("rule")).alias("V_fixed_idents")).distinct()
    told = [sorted(map(str, t.collect())) for t in (chain.templates_of(clean, plain), chain.templates_of_files(clean, files, nodes))]
    assert told[0] == told[1]
    rows = [sorted(map(str, r.collect())) for r in (chain.diff_rows(files, nodes, plain), chain.diff_rows(files, nodes))]
    assert rows[0] == rows[1]


def test_kinds_of_hosts_are_those_of_every_file_by_itself(spark):
    texts = [("x", "jobs:\n  j:\n    steps:\n      - uses: a@v1\n"), ("y", "jobs:\n  k:\n    steps:\n      - uses: a@v2\n"), ("z", "on: push\n")]
    nodes = chain.parsed(spark.createDataFrame(texts, "file_hash string, text string"))
    route = F.array(F.struct(F.lit("pin").alias("ident"), F.lit("jobs.j.steps[0].uses").alias("route")))
    fixed = given(spark)[0].withColumn("V_fixed", F.when(F.col("commit_hash") != "c9", route))
    plain = chain._host_kinds(fixed.filter("V_fixed is not null"), nodes, chain.FILE).select(*chain.FILE, "kind", "n_findings", "n_survived")
    by_file, _ = chain.classify_hosts(fixed, nodes)
    kept = by_file.filter("commit_hash <> 'c9'").select(plain.columns)
    assert sorted(map(str, kept.collect())) == sorted(map(str, plain.collect()))
