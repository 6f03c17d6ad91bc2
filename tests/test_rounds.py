"""Histories walked in rounds: answers of the eager walk, with the scans that they need."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from driftwell.operators import chain
from driftwell.operators.gaps import FIXED
from driftwell.schemas import SCHEMAS
from driftwell.sources import scanner


def forge_of(spark, histories, idents):
    """Tables of one file a branch: ``histories`` gives each branch's versions, newest first: clean, bad, odd, none."""
    audits = [("o/r", "c1", b, "main", "ok", idents, FIXED, 0, []) for b in histories]
    clean = [("o/r", "c1", None, 1, idents, 1, [("f.yml", "x", "y", "ok", [(idents[0], "r")], [])])]
    history, files = [], []
    for b, versions in histories.items():
        for i, kind in enumerate(versions):
            sha = f"{b}{i}"
            history.append(("o/r", b, "f.yml", i, sha, f"2024-01-{28 - i % 27:02d}T00:00:00Z"))
            if kind != "none":
                files.append(("o/r", sha, "f.yml", bytearray(f"{kind} {b} {i // 2}", "utf8"), f"{kind} {b} {i // 2}", False))
    frame = lambda rows, name: spark.createDataFrame(rows, SCHEMAS[name])
    return (
        frame(audits, "gaps"), frame(clean, "clean_fix_meta"), frame(history, "file_history"),
        frame([("o/r", "c1", "2024-01-10T00:00:00Z", "p")], "commit_info"), frame(files, "file_at_ref"),
    )


def walk(spark, histories, step, cap):
    audits, clean, history, info, files = forge_of(spark, histories, ["perm"])
    scanned, fetched = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def check(content):
        scanned.add(1)
        if content.startswith(b"odd"):
            raise ValueError("can't be read")
        return [{"ident": "perm", "route": "r"}] if content.startswith(b"bad") else []

    def fetch(asked):
        fetched.add(asked.count())
        return files.withColumnRenamed("ref", "commit_sha").join(asked, ["repository", "commit_sha", "path"], "left_semi")

    found, _ = chain.rounds_of_histories(audits, clean, history, info, fetch, lambda b: scanner.scan(b, check), step, cap)
    got = {r.branch: tuple(r[c] for c in ("status", "reason", "backport_version", "backported_at", "lag_days", "refined")) for r in found.collect()}
    lazy, asked = scanned.value, fetched.value
    blobs = files.select(F.col("blob_sha").alias("file_hash"), "content")
    eager = chain.branch_histories(audits, clean, history, files, scanner.scan(blobs, check), info, cap)
    want = {r.branch: tuple(r[c] for c in ("status", "reason", "backport_version", "backported_at", "lag_days", "refined")) for r in eager.collect()}
    return got, want, lazy, asked


@pytest.mark.parametrize(("step", "cap"), [(1, 50), (3, 4)])
def test_rounds_answer_as_the_eager_walk(spark, step, cap):
    rng = random.Random(9)
    histories = {f"b{k}": [rng.choice(["clean", "clean", "clean", "bad", "odd", "none"]) for _ in range(rng.randrange(9))] for k in range(25)}
    got, want, _, _ = walk(spark, histories, step, cap)
    assert got == want and len({x[0] for x in got.values()}) > 2


def test_scans_are_those_that_are_needed(spark):
    histories = {"early": ["clean"] * 2 + ["bad"] + ["clean"] * 30, "late": ["clean"] * 10 + ["bad"] + ["clean"] * 10, "never": ["clean"] * 6}
    got, want, scans, fetches = walk(spark, histories, 3, 50)
    assert got == want and got["late"][2] == "late9"
    # a walk that stops at the first answer reads 3, 11 and 6 versions; two versions share a blob
    assert fetches <= 3 + 11 + 6 + 3 * 2 and scans <= 2 + 6 + 3 + 3


def test_nothing_to_walk(spark):
    got, want, scans, _ = walk(spark, {"b": []}, 4, 50)
    assert got == want == {"b": ("inconclusive", "no_scannable_history", None, None, None, "inconclusive")} and scans == 0


@pytest.mark.parametrize("eager", [False, True])
def test_commits_that_fixed_the_same_idents_share_their_walks(spark, monkeypatch, eager):
    """A walk is made once for a file, branch and set of idents; each commit gets its answer, with its own lag."""
    _, _, history, _, files = forge_of(spark, {"b": ["clean", "bad"], "c": ["clean"]}, ["perm"])
    commits = [(f"c{i}", ["perm"] if i % 3 else ["other"], i + 1) for i in range(9)]
    frame = lambda rows, name: spark.createDataFrame(rows, SCHEMAS[name])
    audits = frame([("o/r", c, b, "main", "ok", i, FIXED, 0, []) for c, i, _ in commits for b in "bc"], "gaps")
    clean = frame([("o/r", c, None, 1, i, 1, [("f.yml", "x", "y", "ok", [(i[0], "r")], [])]) for c, i, _ in commits], "clean_fix_meta")
    info = frame([("o/r", c, f"2024-01-{d:02d}T00:00:00Z", "p") for c, _, d in commits], "commit_info")
    walked, boundary = [], chain.history.history_boundary
    monkeypatch.setattr(chain.history, "history_boundary", lambda rows, entity, *a: walked.append(rows.select(*entity).distinct().count()) or boundary(rows, entity, *a))
    check = lambda content: [{"ident": "perm", "route": "r"}] if content.startswith(b"bad") else []
    if eager:
        found = chain.branch_histories(audits, clean, history, files, scanner.scan(files.select(F.col("blob_sha").alias("file_hash"), "content"), check), info)
    else:
        fetch = lambda asked: files.withColumnRenamed("ref", "commit_sha").join(asked, ["repository", "commit_sha", "path"], "left_semi")
        found, _ = chain.rounds_of_histories(audits, clean, history, info, fetch, lambda b: scanner.scan(b, check))
    assert walked == [4]
    got = {(r.commit_hash, r.branch): (r.status, r.backport_version, r.lag_days) for r in found.collect()}
    want = {(c, b): ("confirmed_backport", "b0", 28.0 - d) if b == "b" and i == ["perm"] else ("never_had_it", None, None) for c, i, d in commits for b in "bc"}
    assert got == want
