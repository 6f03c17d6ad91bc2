"""The memo of scans, and batches that are committed whole."""

from __future__ import annotations

import pytest

from driftwell.catalog import Catalog
from driftwell.schemas import SCHEMAS
from driftwell.streaming.memo import ScanMemo


def counted(spark):
    calls = spark.sparkContext.accumulator(0)

    def check(content):
        calls.add(1)
        if content == b"bad":
            raise KeyError("no such thing")
        return [{"ident": content.decode(), "route": "r", "severity": None}]

    return calls, check


def test_a_blob_is_scanned_once_over_all_questions(spark, tmp_path):
    calls, check = counted(spark)
    blobs = lambda *names: spark.createDataFrame([(n, bytearray(n, "utf8")) for n in names], "file_hash string, content binary")
    memo = ScanMemo(spark, str(tmp_path), check, parts=2)
    assert memo.ask(blobs("a").filter("false")).count() == 0
    assert {(r.file_hash, r.ok, r.findings[0].ident) for r in memo.ask(blobs("a", "b", "a")).collect()} == {("a", True, "a"), ("b", True, "b")}
    assert calls.value == 2
    again = {r.file_hash: r for r in memo.ask(blobs("b", "c", "bad")).collect()}
    assert calls.value == 4 and again["b"].findings[0].route == "r" and not again["bad"].ok and "no such thing" in again["bad"].error
    # another start of the program, from the checkpoint; what failed is tried again
    later = ScanMemo(spark, str(tmp_path), check, parts=2)
    assert {r.file_hash for r in later.ask(blobs("a", "bad")).collect()} == {"a", "bad"} and calls.value == 5
    assert later.ask(blobs("a").filter("false")).count() == 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_old_scans_are_made_anew(spark, tmp_path):
    calls, check = counted(spark)
    memo = ScanMemo(spark, str(tmp_path), check, ttl=0.0, parts=1)
    blob = spark.createDataFrame([("a", bytearray(b"a"))], "file_hash string, content binary")
    assert memo.ask(blob).count() == memo.ask(blob).count() == 1 and calls.value == 2


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    rows = lambda n: spark.createDataFrame([("o/r", f"c{n}", f"2024-01-0{n}", "s", "audited", None, None)], SCHEMAS["outcomes"])
    repos = lambda n: spark.createDataFrame([(f"r{n}", "main")], SCHEMAS["repos"])

    class Broken:
        """A table whose writing fails, as if the program had been killed between two tables."""

        write = property(lambda self: (_ for _ in ()).throw(RuntimeError("killed")))

    with pytest.raises(RuntimeError):
        cat.commit(0, {"outcomes": rows(1), "repos": Broken()})
    assert cat.log("outcomes").count() == 0 and not cat.committed(0)
    cat.commit(0, {"outcomes": rows(1), "repos": repos(1)})
    cat.commit(0, {"outcomes": rows(2), "repos": repos(2)})  # done already
    assert [r.commit_hash for r in cat.log("outcomes").collect()] == ["c1"] and cat.log("repos").count() == 1
    cat.commit(1, {"outcomes": rows(1), "repos": repos(2)})
    cat.commit(2, {"outcomes": rows(3)})
    assert cat.log("outcomes").count() == 2 and cat.log("repos", but=1).count() == 1
    assert cat.compact() == 2 and cat.committed(1)
    assert {r.commit_hash for r in cat.log("outcomes").collect()} == {"c1", "c3"} and cat.log("repos").count() == 2
    cat.commit(3, {"repos": repos(4)})
    assert {r.repository for r in cat.log("repos").collect()} == {"r1", "r2", "r4"}
    assert len(cat._named()) == 3
