from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from driftwell.operators import gaps, history, reports, scopes

FIX = "array<struct<ident:string,route:string>>"


def test_audit(spark):
    clean = spark.createDataFrame(
        [("r", "c1", ["x", "y"], [("f1", [("x", "")]), ("f2", [("y", "")]), ("f3", [])]), ("r", "c2", ["x"], [("f1", [("x", "")])]), ("q", "c3", ["x"], [("f1", [("x", "")])])],
        f"repository string, commit_hash string, V_fixed_idents array<string>, files array<struct<file_path:string,V_fixed:{FIX}>>",
    )
    repos = spark.createDataFrame([("r", "main")], "repository string, default_branch string")
    branches = spark.createDataFrame([("r", b, "h") for b in ("main", "v1", "v2", "v3", "v4", "dev")], "repository string, branch string, head_sha string")
    on = spark.createDataFrame([("r", "main", "c1", True), ("r", "main", "c2", False)], "repository string, branch string, commit_hash string, reachable boolean")
    at = spark.createDataFrame([("r", "v1", "f1", "b1", False), ("r", "v1", "f2", "b0", False), ("r", "v2", "f1", "b0", False), ("r", "v3", "f1", "bad", False), ("r", "v4", "f1", None, True)], "repository string, ref string, path string, blob_sha string, missing boolean")
    scans = spark.createDataFrame([("b1", True, [("x", "", "", "")]), ("b0", True, []), ("bad", False, None)], "file_hash string, ok boolean, findings array<struct<ident:string,severity:string,confidence:string,route:string>>")
    rows = gaps.audit(clean, repos, branches, on, at, scans).collect()
    assert {(r.commit_hash, r.branch): (r.status, r.verdict) for r in rows} == {
        ("c1", "v1"): ("ok", "gap"), ("c1", "v2"): ("ok", "already_fixed"), ("c1", "v3"): ("ok", "already_fixed"), ("c1", "v4"): ("ok", "inapplicable"),
        ("c2", None): ("not_on_default", None), ("c3", None): ("repo_error", None),
    }
    assert {r.branch: r.n_scan_failed for r in rows if r.commit_hash == "c1"} == {"v1": 0, "v2": 0, "v3": 1, "v4": 0}
    none = gaps.headline(gaps.audit(clean, repos, branches, on, at, scans).filter("verdict is null")).first()
    assert none.n_branches == 0 and none.gap_rate is None


def walk_history(versions, cap=50):
    newer, read = None, 0
    for v, ok, hit in versions:
        if read >= cap:
            return "inconclusive", "history_cap_reached", None
        if not ok:
            continue
        read += 1
        if hit:
            return ("confirmed_backport", None, newer) if newer is not None else ("inconclusive", "fix_present_at_head_contradicts_already_fixed", None)
        newer = v
    return ("never_had_it", None, None) if read else ("inconclusive", "no_scannable_history", None)


def test_history_as_by_walking(spark):
    rnd, cases = random.Random(5), {}
    for e in range(60):
        n = rnd.choice([1, 3, 6, 12])
        cases[e] = [(v, rnd.random() < 0.7, rnd.random() < 0.15) for v in range(n)]
    cases[100] = [(v, True, False) for v in range(50)]
    cases[101] = [(v, True, False) for v in range(51)]
    cases[102] = [(v, True, v == 50) for v in range(60)]
    at = dt.datetime(2024, 1, 1)
    rows = [(e, v, at + dt.timedelta(days=v), ok, hit) for e, vs in cases.items() for v, ok, hit in vs]
    df = spark.createDataFrame(rows, "e int, v int, at timestamp_ntz, ok boolean, hit boolean")
    for cap in (50, 4):
        got = {r.e: (r.status, r.reason, r.backport_version) for r in history.history_boundary(df, ["e"], [F.col("v")], "v", "at", "ok", "hit", cap).collect()}
        assert got == {e: walk_history(vs, cap) for e, vs in cases.items()}


def test_lags_branches_and_percentiles(spark):
    bound = spark.createDataFrame([("a", "confirmed_backport", dt.datetime(2024, 1, 3)), ("b", "never_had_it", None), ("c", "confirmed_backport", None)], "k string, status string, backported_at timestamp_ntz")
    masters = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 12)), ("c", dt.datetime(2024, 1, 1))], "k string, fixed timestamp_ntz")
    got = {r.k: (r.lag_days, r.refined) for r in history.with_lag(bound, masters, ["k"], "fixed").collect()}
    assert got == {"a": (1.5, "true_backport"), "b": (None, "never_had_it"), "c": (None, "confirmed_backport_no_lag")}
    values = [4.0, 1.0, 3.0, 2.0]
    df = spark.createDataFrame([(v,) for v in values + [None]], "v double")
    shares = {"p0": 0.0, "half": 0.5, "p90": 0.9, "all": 1.0}
    assert {r.name: r.value for r in history.percentiles(df, "v", shares).collect()} == {n: sorted(values)[min(int(s * 4), 3)] for n, s in shares.items()}
    why = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", None, 3), ("j", None, 1)], "k string, r string, at int")
    assert {r.k: r.r for r in history.dominant_reason(why, ["k"], "r", "at").collect()} == {"k": "b", "j": "unknown"}


def test_local_and_global_oracles(spark):
    keys = ["t"]
    programs = spark.createDataFrame([(t, ["x"]) for t in "abcde"], "t string, target_idents array<string>")
    landed = spark.createDataFrame([("a", "jobs.j", 0), ("a", "", 1), ("b", "jobs.j.steps[1]", 0), ("c", "jobs.j", 0), ("d", "jobs.j", 0)], "t string, scope string, scope_order int")
    before = spark.createDataFrame([("a", "x", "jobs.j.run"), ("b", "x", "jobs.j.steps[1].run"), ("b", "x", "jobs.j.steps[11]"), ("c", "x", "jobs.j"), ("d", "x", "jobs.j"), ("e", "x", "on")], "t string, ident string, route string")
    after = spark.createDataFrame([("b", "x", "jobs.j.steps[11]"), ("c", "x", "jobs.j"), ("d", "z", "jobs.j[0]"), ("d", "z", "jobs.jj")], "t string, ident string, route string")
    got = {r.t: (r.n_failed, r.n_introduced, r.success) for r in scopes.local_oracle(programs, landed, before, after, keys).collect()}
    assert got == {"a": (0, 0, True), "b": (0, 0, True), "c": (1, 0, False), "d": (0, 1, False), "e": (0, 0, False)}
    whole = {r.t: (r.n_reduced, r.n_introduced, r.success) for r in scopes.global_oracle(programs, before, after, keys).collect()}
    assert whole == {"a": (1, 0, True), "b": (1, 0, True), "c": (0, 0, False), "d": (1, 2, False), "e": (1, 0, True)}


def test_reports(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (2, "c"), (2, "a"), (3, "c")], "k int, ident string")
    assert {(r.a, r.b): r.n for r in reports.co_occurrence(rows, ["k"], "ident").collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    text = reports.markdown(spark.createDataFrame([("x|y", 1), (None, 2)], "a string, n int"))
    assert text == "| a | n |\n| --- | --- |\n| x\\|y | 1 |\n|  | 2 |\n"


def test_commits_that_look_for_the_same_share_their_verdicts(spark, monkeypatch):
    """Files of branches are judged once for each repository, list of files and idents; only audited commits get it."""
    fixed = lambda paths: [(p, [("x", "")]) for p in paths]
    rows = [("r", f"c{i}", ["x"] if i % 2 else ["y"], fixed(["f1", "f2"] if i < 6 else ["f1"])) for i in range(9)]
    clean = spark.createDataFrame(rows, f"repository string, commit_hash string, V_fixed_idents array<string>, files array<struct<file_path:string,V_fixed:{FIX}>>")
    repos = spark.createDataFrame([("r", "main")], "repository string, default_branch string")
    branches = spark.createDataFrame([("r", b, "h") for b in ("main", "v1", "v2")], "repository string, branch string, head_sha string")
    on = spark.createDataFrame([("r", "main", c, c != "c3") for _, c, _, _ in rows], "repository string, branch string, commit_hash string, reachable boolean")
    at = spark.createDataFrame([("r", "v1", "f2", "b1", False), ("r", "v2", "f1", "b1", False)], "repository string, ref string, path string, blob_sha string, missing boolean")
    scans = spark.createDataFrame([("b1", True, [("x", "", "", "")])], "file_hash string, ok boolean, findings array<struct<ident:string,severity:string,confidence:string,route:string>>")
    judged, verdict = [], gaps.branch_verdict
    monkeypatch.setattr(gaps, "branch_verdict", lambda files, *a: judged.append(files.count()) or verdict(files, *a))
    got = {(r.commit_hash, r.branch): (r.status, r.verdict) for r in gaps.audit(clean, repos, branches, on, at, scans).collect()}
    of = lambda i, b: "inapplicable" if i >= 6 and b == "v1" else "gap" if i % 2 else "already_fixed"
    assert judged == [12]
    assert got == {(f"c{i}", b): ("ok", of(i, b)) for i in range(9) if i != 3 for b in ("v1", "v2")} | {("c3", None): ("not_on_default", None)}
