"""A record's time budget, measured where the work is done."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from driftwell.operators.budget import histories_within, no_speculation, over_budget, refined, run_record, walk_one


def check(content):
    return [{"ident": "perm"}] if content == b"bad" else []


def slow_forge():
    """(client, checker): branches named slow take their time for each version; made here, so that both travel by value."""

    class Slow:
        def versions(self, repository, branch, path):
            if branch == "gone":
                raise OSError("no such branch")
            return [(f"{branch}{i}", f"2024-01-0{9 - i}T00:00:00Z") for i in range(4)]

        def content(self, repository, path, version):
            if version.startswith("slow"):
                time.sleep(30)
            return b"bad" if version.endswith("2") else None if version.endswith("0") else b"good"

    return (lambda: Slow()), (lambda content: [{"ident": "perm"}] if content == b"bad" else [])


def test_branches_of_one_record_are_mixed(spark):
    rows = [("o/r", "c1", b, "f.yml", ["perm"]) for b in ("fast", "slow1", "other", "slow2", "gone")] + [("o/r", "c2", "fast", "f.yml", ["nothing"])]
    asked = spark.createDataFrame(rows, "repository string, commit_hash string, branch string, path string, V_fixed_idents array<string>")
    began = time.monotonic()
    forge, checker = slow_forge()
    found = histories_within(asked, forge, checker, seconds=4.0, workers=8).cache()
    got = {(r.commit_hash, r.branch): (r.status, r.backport_version, r.n_read) for r in found.collect()}
    assert time.monotonic() - began < 29
    assert got == {
        ("c1", "fast"): ("confirmed_backport", "fast1", 2), ("c1", "other"): ("confirmed_backport", "other1", 2), ("c1", "slow1"): ("timed_out", None, None),
        ("c1", "slow2"): ("timed_out", None, None), ("c1", "gone"): ("error", None, None), ("c2", "fast"): ("never_had_it", None, 3),
    }
    assert [tuple(r) for r in over_budget(found).collect()] == [("o/r", "c1", 3, 2)]
    told = refined(found.withColumn("lag_days", F.lit(5.0)))
    assert {r.branch: r.refined for r in told.filter("commit_hash = 'c1'").collect()} == {"fast": "true_backport", "other": "true_backport", "slow1": "timed_out", "slow2": "timed_out", "gone": "error"}


@pytest.mark.parametrize(
    ("bodies", "cap", "want"),
    [
        ([b"good", b"bad"], 9, ("confirmed_backport", None, "v0", 2)), ([b"bad"], 9, ("inconclusive", "fix_present_at_head_contradicts_already_fixed", None, 1)),
        ([None, None], 9, ("inconclusive", "no_scannable_history", None, 0)), ([], 9, ("inconclusive", "no_scannable_history", None, 0)),
        ([b"good"] * 3, 2, ("inconclusive", "history_cap_reached", None, 2)), ([b"good"] * 2, 2, ("never_had_it", None, None, 2)),
    ],
)
def test_one_walk(bodies, cap, want):
    asked = []
    got = walk_one([(f"v{i}", "t") for i in range(len(bodies))], lambda v: asked.append(v) or bodies[int(v[1:])], check, {"perm"}, cap)
    assert (got["status"], got["reason"], got["backport_version"], got["n_read"]) == want
    assert len(asked) <= cap or None in bodies


def test_order_and_failures():
    def work(item):
        if item["i"] == 2:
            raise KeyError("x")
        return {"status": str(item["i"])}

    assert [r["status"] for r in run_record([{"i": i} for i in range(4)], work, 5, 2)] == ["0", "1", "error", "3"]
    assert run_record([], work, 1, 2) == []


def test_speculation_is_refused(spark):
    no_speculation(spark)
