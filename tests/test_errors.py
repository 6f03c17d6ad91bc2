"""Errors befall their own commits; a batch costs what its own commits cost."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftwell.catalog import Catalog
from driftwell.schemas import SCHEMAS
from driftwell.streaming.incremental import good_rows, run_available
from driftwell.streaming.memo import ScanMemo

HEADER = "repository,commit_hash,committed_date,file_path,file_hash,previous_file_hash,git_change_type,valid_yaml,valid_workflow,probably_workflow\n"
GOOD, BAD = "on: push\n", "# bad x on\non: push\n"


def line(commit, new, old, path="f.yml"):
    return f"o/r,{commit},2024-01-01T00:00:00Z,{path},{new},{old},M,True,True,True\n"


def test_one_commit_that_breaks_a_job_is_found(spark):
    rows = spark.createDataFrame([("o/r", f"c{i}", i) for i in range(20)], "repository string, commit_hash string, i int")
    runs = []

    def work(part):
        runs.append(1)
        return {"t": part.withColumn("x", F.when(F.col("i").isin(3, 11), F.raise_error(F.lit("no good"))).otherwise(F.col("i"))).checkpoint()}

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    done, failed = good_rows(rows, work)
    assert sorted(r.i for r in done["t"].collect()) == [i for i in range(20) if i not in (3, 11)]
    assert sorted(r.commit_hash for part, _ in failed for r in part.collect()) == ["c11", "c3"] and len(runs) < 40
    assert all("no good" in error for _, error in failed)
    done, failed = good_rows(rows, work, tries=2)
    assert sum(part.count() for part, _ in failed) + (done["t"].count() if done else 0) == 20


@pytest.fixture
def driven(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "out"))
    texts = {"o": BAD, "n": GOOD, **{f"o{i}": f"{BAD}# {i}\n" for i in range(9)}, **{f"n{i}": f"{GOOD}# {i}\n" for i in range(9)}, "h": GOOD + "# head\n"}
    held = spark.createDataFrame(list(texts.items()), "file_hash string, text string")
    for name, rows in (("repos", [("o/r", "main")]), ("branches", [("o/r", "release/1", "h")]), ("commit_on_branch", [("o/r", "main", f"c{i}", True) for i in range(9)]), ("file_at_ref", [("o/r", "release/1", "f.yml", bytearray(b"x"), "h", False)])):
        cat.replace(name, spark.createDataFrame(rows, SCHEMAS[name]))
    calls = spark.sparkContext.accumulator(0)

    def check(content):
        calls.add(1)
        return [{"ident": x.split()[2], "route": x.split()[3]} for x in content.decode().splitlines() if x.startswith("# bad")]

    memo = ScanMemo(spark, str(tmp_path / "memo"), check, parts=1)
    scans = lambda hashes: memo.ask(held.select("file_hash", F.encode("text", "UTF-8").alias("content")).join(hashes, "file_hash"))
    (tmp_path / "index").mkdir()

    def run(texts_of=None):
        run_available(spark, str(tmp_path / "index"), cat, scans, texts_of or (lambda hashes: held.join(hashes, "file_hash", "left_semi")), str(tmp_path / "state"), 1)

    return cat, run, tmp_path / "index", held, calls


def test_blobs_of_commits_and_branches_are_scanned_once(driven):
    cat, run, index, _, calls = driven
    for i in range(2):
        (index / f"{i}.csv").write_text(HEADER + line(f"c{i}", "n", f"o{i}"))
        run()
    # n, o0, o1 and the branch's head, over two batches
    assert calls.value == 4
    assert sorted((r.commit_hash, r.outcome) for r in cat.log("outcomes").collect()) == [(f"c{i}", "audited") for i in range(2)]
    assert cat.log("gaps").filter("verdict is not null").count() == 2


def test_one_bad_commit_alone_is_an_exception(spark, driven):
    cat, run, index, held, _ = driven
    (index / "1.csv").write_text(HEADER + line("c1", "n1", "o1") + line("c2", "n2", "o2") + line("c3", "n3", "o3"))
    broken = lambda hashes: held.join(hashes, "file_hash", "left_semi").withColumn("text", F.when(F.col("file_hash") == "n2", F.raise_error(F.lit("a bad block"))).otherwise(F.col("text")))
    run(broken)
    got = {r.commit_hash: (r.outcome, r.error) for r in cat.log("outcomes").collect()}
    assert {k: v[0] for k, v in got.items()} == {"c1": "audited", "c2": "exception", "c3": "audited"} and "a bad block" in got["c2"][1]
    assert {r.commit_hash for r in cat.log("clean_fix_meta").collect()} == {"c1", "c3"}
    (index / "2.csv").write_text(HEADER + line("c4", "n4", "o4"))
    run()  # the store is whole again
    assert sorted((r.commit_hash, r.outcome) for r in cat.log("outcomes").collect()) == [(f"c{i}", "audited") for i in range(1, 5)]
