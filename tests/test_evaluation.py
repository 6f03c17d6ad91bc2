from __future__ import annotations

import base64
import hashlib
import json
import sys

import pytest
from pyspark.sql import functions as F

from driftwell import cli
from driftwell.catalog import Catalog
from driftwell.functions.digests import blake2b_lines, blake2b_unit
from driftwell.operators import evaluation, history, scopes
from driftwell.operators.reports import markdown
from driftwell.schemas import SCHEMAS
from driftwell.sources import remote


def test_comparison_with_human_patches(spark):
    rows = [
        ("a", "s", "p", "x: 0", "x: 1", "x: 1", None), ("b", "s", "p", "x: 0", "x: 1\ny: 2", "y: 2   # c\nx: 1.0", None), ("c", "s", "p", "x: 0", "x: 1", "x: 2", True),
        ("d", "s", "p", "x: 0", "x: 1", "x: 2", None), ("e", None, "p", "x: 0", "x: 1", "x: 2", None), ("f", "s", None, "x: 0", "x: 1", "x: 2", None),
        ("g", "s", "p", None, "x: 1", "x: 2", None), ("h", "s", "p", "x: 0", "x: 1", None, None), ("i", "s", "p", "x: [", "x: [", "x: [", None),
    ]
    df = spark.createDataFrame(rows, "k string, backport_sha string, parent_sha string, parent_text string, human_text string, patched_text string, effect boolean")
    got = {r.k: r.outcome for r in evaluation.compare_with_human(df, ["k"]).collect()}
    assert got == {"a": "byte_equal", "b": "ast_equal", "c": "effect_equal", "d": "divergent", "e": "missing_backport_sha", "f": "no_parent_commit", "g": "file_absent_at_parent_or_backport", "h": "no_program", "i": "byte_equal"}
    f = lambda rows: spark.createDataFrame(rows, "k string, ident string, route string")
    effects = evaluation.same_effect(f([("a", "x", "r"), ("b", "x", "r")]), f([("a", "x", "r"), ("b", "x", "q")]), ["k"])
    assert {r.k: r.effect for r in effects.collect()} == {"a": True, "b": False}


def test_verdicts_and_generators(spark):
    runs = spark.createDataFrame([("a", "patched", 0), ("b", "patched", 1), ("c", "patched", 0), ("d", "target_absent", 0), ("e", "patched", 0)], "k string, status string, n_needs_review long")
    local = spark.createDataFrame([("a", 1, 0, 0, True), ("c", 1, 0, 0, True), ("e", 2, 1, 0, False)], "k string, n_scopes long, n_failed long, n_introduced long, success boolean")
    lint = spark.createDataFrame([("c", "syntax", "m")], "k string, kind string, message string")
    got = {r.k: (r.accepted, r.bucket) for r in evaluation.verdict(runs, local, lint, ["k"]).collect()}
    assert got == {"a": (True, "accepted"), "b": (False, "needs_review_only"), "c": (False, "failed_actionlint"), "d": (False, "fetch_or_compile_error"), "e": (False, "failed_zizmor_local")}
    out = spark.createDataFrame([("a", " ", "ok", True, True), ("b", "t", "scan_error", None, None), ("c", "t", "ok", True, True), ("d", "t", "ok", False, True), ("e", "t", "ok", True, False)], "k string, output string, oracle_status string, oracle_ok boolean, lint_ok boolean")
    assert {r.k: r.outcome for r in evaluation.generator_outcome(out).collect()} == {"a": "no_output", "b": "oracle_error", "c": "accepted", "d": "failed_zizmor", "e": "failed_actionlint"}


def test_digests(spark):
    row = spark.createDataFrame([("abc", ["l1", "l2"], [])], "k string, l array<string>, e array<string>").select(blake2b_unit(F.col("k")).alias("u"), blake2b_lines(F.col("l")).alias("l"), blake2b_lines(F.col("e")).alias("e")).first()
    assert row.u == int.from_bytes(hashlib.blake2b(b"42:abc", digest_size=8).digest(), "big") / 2**64
    assert row.l == hashlib.blake2b(b"l1\nl2\n", digest_size=10).hexdigest() and row.e == hashlib.blake2b(digest_size=10).hexdigest()


def test_forge_tables_by_key(monkeypatch):
    pages = {
        "http://x/repos/o/r/compare/main...abc": {"status": "behind"}, "http://x/repos/o/r/commits/abc": {"commit": {"committer": {"date": "d"}}, "parents": [{"sha": "p"}]},
        "http://x/repos/o/r/contents/a/f.yml?ref=v1": {"content": base64.b64encode(b"hi").decode(), "sha": "s"}, "http://x/repos/o/r/contents/a?ref=v1": [1],
        "http://x/repos/o/r/commits?sha=v1&path=f&per_page=100": [{"sha": "1", "commit": {"committer": {"date": "d1"}}}], "next": [{"sha": "2", "commit": {"committer": {"date": "d2"}}}],
    }
    monkeypatch.setattr(remote, "get_json", lambda url, token="": (pages.get(url), "next" if "per_page" in url else None))
    ask = lambda table, *keys: list(remote.ForgeReader({"base": "http://x/", "table": table, "repositories": '["o/r"]', "asked": json.dumps({"o/r": keys})}).read(remote.InputPartition("o/r")))
    assert ask("commit_on_branch", ["main", "abc"], ["main", "zzz"]) == [("o/r", "main", "abc", True), ("o/r", "main", "zzz", False)]
    assert ask("commit_info", ["abc"], ["nope"]) == [("o/r", "abc", "d", "p")]
    assert ask("file_at_ref", ["v1", "a/f.yml"], ["v1", "a"]) == [("o/r", "v1", "a/f.yml", b"hi", "s", False), ("o/r", "v1", "a", None, None, True)]
    assert ask("file_history", ["v1", "f"]) == [("o/r", "v1", "f", 0, "1", "d1"), ("o/r", "v1", "f", 1, "2", "d2")]


SCANNER = """import json, re, sys
text = sys.stdin.read()
found = [{"ident": "perm", "route": "permissions"}] if "permissions: write-all" in text else []
found += [{"ident": "pin", "route": f"jobs.{j}.steps[0].uses"} for j in re.findall(r"  (\\w+):\\n    steps:\\n      - uses: x/y@v", text)]
print(json.dumps(found))
"""


def test_commands_from_index_to_reports(spark, tmp_path):
    """The whole way by commands: index, diffs, scans, clean fixes, patterns, match, audit, history, patches, reports."""
    head = "repository,commit_hash,committed_date,file_path,file_hash,previous_file_hash,git_change_type,valid_yaml,valid_workflow,probably_workflow\n"
    row = "o/r,{0},2024,f.yml,{1},{2},M,True,True,True\n"
    (tmp_path / "index.csv").write_text(head + row.format("c1", "n1", "o1") + row.format("c2", "n2", "o1") + row.format("c3", "n3", "o3"))
    (tmp_path / "new.csv").write_text(head + row.format("d1", "n1", "o1") + row.format("d2", "n4", "o1") + row.format("d3", "n5", "o3"))
    (tmp_path / "scan.py").write_text(SCANNER)
    step = lambda ref, job="a": f"jobs:\n  {job}:\n    steps:\n      - uses: x/y@{ref}\n"
    sha = "1" * 40
    texts = {
        "o1": "permissions: write-all\n" + step("v1"), "n1": "permissions: read-all\n" + step("v1"), "n2": "permissions: write-all\n" + step("v1") + "name: x\n", "n4": "permissions:\n  contents: read\n" + step("v1"),
        "o3": "permissions: read-all\n" + step("v1"), "n3": "permissions: read-all\n" + step(sha), "n5": "permissions: read-all\njobs: {}\n", "h": "# kept\npermissions: write-all # wide\n" + step("v2", "z"),
    }
    frame = lambda rows, name: spark.createDataFrame(rows, SCHEMAS[name])
    for tag in ("default", "other"):
        cat = Catalog(spark, str(tmp_path / "root"), tag)
        cat.replace("blobs", frame([(k, v.encode()) for k, v in texts.items()], "blobs"))
    cat = Catalog(spark, str(tmp_path / "root"))
    cat.replace("repos", frame([("o/r", "main")], "repos"))
    cat.replace("branches", frame([("o/r", "v1", "h"), ("o/r", "release/2", "h"), ("o/r", "main", "h")], "branches"))
    cat.replace("commit_on_branch", frame([("o/r", "main", c, True) for c in ("c1", "c3")], "commit_on_branch"))
    at = [("o/r", "v1", "f.yml", texts["h"].encode(), "h", False), ("o/r", "release/2", "f.yml", texts["n3"].encode(), "n3", False), ("o/r", "s0", "f.yml", texts["n3"].encode(), "n3", False), ("o/r", "s1", "f.yml", texts["h"].encode(), "h", False)]
    cat.replace("file_at_ref", frame(at, "file_at_ref"))
    cat.replace("file_history", frame([("o/r", "release/2", "f.yml", 0, "s0", "2024-03-01T00:00:00Z"), ("o/r", "release/2", "f.yml", 1, "s1", "2023-01-01T00:00:00Z")], "file_history"))
    cat.replace("commit_info", frame([("o/r", "c1", "2024-01-01T00:00:00Z", "p"), ("o/r", "c3", "2024-02-29T12:00:00Z", "p"), ("o/r", "s0", "2024-03-01T00:00:00Z", "s1")], "commit_info"))
    cat.replace("ref_resolution", frame([("x/y", "v2", "2" * 40)], "ref_resolution"))
    scan = ["--scanner", f"{sys.executable} {tmp_path / 'scan.py'}"]
    run = lambda *a: cli.main([*a, "--root", str(tmp_path / "root")], spark)
    got = run("pipeline", "--index", str(tmp_path / "index.csv"), *scan)
    assert "| 3 | 3 |" in got and "| n_clean |\n| --- |\n| 2 |" in got and "| perm | 1 | 1 | 1 |" in got and "| pin | 1 | 1 | 2 |" in got
    lines = [line for r in cat.read("patterns").collect() for s in r.structural_subclusters for line in s.template_lines]
    assert sorted(lines) == ["~ jobs.a.steps[uses=x/y].uses : uses:x/y@<tag> -> uses:x/y@<sha>", "~ permissions : perm:write-all -> perm:read-all"]
    assert [r.dir for r in cat.read("clean_fix_index").collect()] == ["o__r__c1", "o__r__c3"] and cat.read("export").count() == 4
    run("pipeline", "--index", str(tmp_path / "new.csv"), *scan, "--tag", "other")
    got = run("match", "--new", "other")
    assert "| full | 1 | 0.333333 |" in got and "| level-1 | 2 | 0.666667 |" in got
    assert "| structural | 2 | 1.0 |" in run("classify")
    got = run("find-gaps", *scan)
    assert "| 4 | 2 | 2 | 0 | 0.5 | 0.5 |" in got
    assert "| ok | 2 |" in run("gaps-summary")
    run("classify-history")
    got = run("history-summary")
    assert "| true_backport | 1 | 0.5 |" in got and "| same_day_fix | 1 | 0.5 |" in got and "| perm | true_backport | 1 |" in got and "| o/r | 1 |" in got
    assert "| structural | 1 | 1 | 2 | 2 | 4 | 2 | 2 | 0 | 0.5 | 0.5 |" in run("refilter")
    assert "| rewrite_value | 2 | 0 |" in run("compile", "--out", str(tmp_path / "programs"))
    program = {r.program.split()[1]: r.text for r in spark.read.parquet(str(tmp_path / "programs")).collect()}
    assert "- permissions: perm:write-all\n+ permissions: read-all" in program["c1"]
    got = run("backport", *scan)
    assert "| accepted | 2 | 1.0 |" in got and "| perm | 1 | 1 | 1.0 |" in got
    texts_of = {r.program.split()[1]: r.patched_text for r in cat.read("patches").collect()}
    assert texts_of["c1"] == "# kept\npermissions: read-all # wide\n" + step("v2", "z") and f"x/y@{'2' * 40} # v2" in texts_of["c3"]
    got = run("compare-generators", *scan)  # the target's own comment hides the line that the hunk looks for
    assert "| patch | accepted | 2 |" in got and "| hunk | failed_zizmor | 2 |" in got and "| bump | no_output | 1 |" in got and "| bump | accepted | 1 |" in got
    got = run("reproduce", *scan)
    assert "| 1 | 0 | 0 | 0 | 0 | 1 |" in got and cat.read("cases").filter("name = 'outcome'").count() == 1
    assert "| patched | 1 | 1.0 |" in run("backport", "--limit", "1")
    (tmp_path / "p.wsp").write_text(program["c1"])
    (tmp_path / "t.yml").write_text(texts["h"])
    assert "| patched | 1 | 1 | 0 |" in run("apply", "--program", str(tmp_path / "p.wsp"), "--target", str(tmp_path / "t.yml"), "--out", str(tmp_path / "done"))
    assert "| 1 | 0 | true |" in run("oracle", *scan, "--target", str(tmp_path / "t.yml"), "--out", str(tmp_path / "done"), "--idents", "perm").lower()
    assert "false" not in run("selfcheck").lower()
    with pytest.raises(SystemExit):
        run("stream-all", "--index", str(tmp_path / "index.csv"))


def test_large_tables_say_that_they_are_cut(spark):
    assert markdown(spark.range(3), 2).endswith("Only the first 2 rows are shown.\n") and "Only" not in markdown(spark.range(2), 2)


def test_findings_that_occur_twice_are_found_twice(spark):
    found = spark.createDataFrame([("p", "x", "a.b"), ("p", "x", "a.b"), ("p", "x", "c")], "k string, ident string, route string")
    scopes_ = spark.createDataFrame([("p", "a", 2), ("p", "a.b", 1)], "k string, scope string, scope_order int")
    assert [tuple(r) for r in scopes.in_scope(found, scopes_, ["k"]).collect()] == [("p", "x", "a.b", "a.b")] * 2


def test_percentiles_of_a_heavy_tail(spark):
    values = [float(i % 977) for i in range(20_000)] + [1e12, -1e12, 5e11]
    rows = spark.createDataFrame([(v, "g") for v in values] + [(None, "g"), (7.0, "h")], "v double, g string")
    shares = {"p01": 0.01, "median": 0.5, "p99": 0.99, "max": 1.0}
    ordered = sorted(values)
    want = {n: ordered[min(int(s * len(ordered)), len(ordered) - 1)] for n, s in shares.items()}
    got = {(r.g, r.name): r.value for r in history.percentiles(rows, "v", shares, ["g"]).collect()}
    assert {n: got["g", n] for n in shares} == want and {got["h", n] for n in shares} == {7.0}
