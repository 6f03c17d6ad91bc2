from __future__ import annotations

import json

import pytest
import yaml
from pyspark.sql import functions as F

from driftwell.functions import trees
from driftwell.functions.trees import document_nodes, equality_key, identity, parse, rewrite, walk
from driftwell.operators import patches
from driftwell.operators.lineage import settle, unsized

BEFORE = """\
name: ci
on: push
permissions: write-all
jobs:
  build:
    runs-on: ubuntu
    secrets: inherit
    steps:
      - uses: acme/fetch@v3   # fetch it
      - name: test
        run: make test
"""
AFTER = """\
name: ci
on: push
permissions: read-all
jobs:
  build:
    runs-on: ubuntu
    secrets:
      TOKEN: x
    timeout-minutes: 10
    steps:
      - uses: acme/fetch@1111111111111111111111111111111111111111
        with:
          keep: false
      - name: test
        run: make test
      - name: extra
        run: make extra
"""
TARGET = """\
# our release
name: ci
on: [push]
permissions: write-all
jobs:
  compile:
    runs-on: ubuntu   # old image
    secrets: inherit
    steps:
      - name: test
        run: make old
      - uses: acme/fetch@v2   # fetch it
"""


def nodes(spark, texts, keys):
    return document_nodes(spark.createDataFrame([(k, t) for k, t in texts.items()], f"{keys[0]} string, text string"), keys)


def compiled(spark, before=BEFORE, after=AFTER):
    return patches.compile_edits(nodes(spark, {"p": before}, ["program"]), nodes(spark, {"p": after}, ["program"]), ["program"])


def run(spark, edits, target, pins=None):
    texts = spark.createDataFrame([("t", target)], "target string, text string")
    pairs = spark.createDataFrame([("p", "t")], "program string, target string")
    pins = pins and spark.createDataFrame(pins, "action string, ref string, sha string")
    patched, outcomes = patches.apply_programs(edits, pairs, texts, document_nodes(texts, ["target"]), ["program"], ["target"], pins)
    return patched.first().patched_text, {(r.ordinal): r for r in outcomes.collect()}


def test_dialects_and_identities():
    assert parse("on: yes", "1.1") == {True: True} and parse("on: yes") == {"on": "yes"} and parse("a: true") == {"a": True}
    assert parse("a: [", "1.1") is None
    assert [identity(e, 4, True) for e in ({"id": "i", "uses": "a@1"}, {"uses": "a/b@v1@2"}, {"name": "n"}, {"run": "x"}, {"name": 3})] == ["id=i", "uses=a/b", "name=n", "run", "anon"]
    assert [identity(e, 4, False) for e in ({"key": "k"}, {"uses": "a"}, "s", True, None, 1.5, [1])] == ["key=k", "#4", "'s'", "True", "None", "1.5", "#4"]
    assert [s[-1] for s, *_ in walk({"steps": [{"run": 1}, {"run": 2}]}) if s and s[-1].startswith("[")] == ["[run~0]", "[run~1]"]
    assert equality_key(True) == equality_key(1) == equality_key(1.0) != equality_key("1")


def test_compile(spark):
    edits = compiled(spark).orderBy("ordinal").collect()
    got = [(r.op, ".".join(r.anchor), r.key, r.value, r.pin_action, r.expected_old, r.review) for r in edits]
    assert got == [
        ("ensure_present", "jobs.$JOB.steps.[name=extra]", "name", '"extra"', None, None, "adds a list element"),
        ("ensure_present", "jobs.$JOB.steps.[name=extra]", "run", '"make extra"', None, None, "adds a list element"),
        ("ensure_present", "jobs.$JOB.steps.[uses=acme/fetch].with", "keep", "false", None, None, None),
        ("ensure_present", "jobs.$JOB", "timeout-minutes", "10", None, None, None),
        ("rewrite_value", "jobs.$JOB", "secrets", '{"TOKEN": "x"}', None, "perm:inherit", None),
        ("rewrite_value", "jobs.$JOB.steps.[uses=acme/fetch]", "uses", '"acme/fetch@1111111111111111111111111111111111111111"', "acme/fetch", "uses:acme/fetch@<tag>", None),
        ("rewrite_value", "", "permissions", '"read-all"', None, "perm:write-all", None),
    ]


def test_apply_on_a_drifted_target_and_replay(spark):
    edits = compiled(spark).cache()
    pins = [("acme/fetch", "v2", "2" * 40)]
    patched, outcomes = run(spark, edits, TARGET, pins)
    assert [outcomes[i].status for i in range(1, 8)] == ["needs_review", "needs_review", "created", "applied", "applied", "applied", "applied"]
    tree = parse(patched)
    job = tree["jobs"]["compile"]
    assert tree["permissions"] == "read-all" and job["secrets"] == {"TOKEN": "x"} and job["timeout-minutes"] == 10
    assert job["steps"] == [{"name": "test", "run": "make old"}, {"uses": "acme/fetch@" + "2" * 40, "with": {"keep": False}}]
    assert outcomes[3].site_paths == ["jobs.compile.steps[1].with.keep"]
    again, second = run(spark, edits, patched, pins)
    assert again == patched and {r.status for r in second.values()} == {"needs_review", "noop"}
    unresolved, third = run(spark, edits, TARGET)
    assert third[6].status == "needs_review" and "unresolved pin acme/fetch@v2" in third[6].reason and "fetch@v2" in unresolved


def test_comments_stay_where_lines_are_edited_in_place(spark):
    edits = compiled(spark, "permissions: write-all\nx: 1\n", "permissions: read-all\nx: 1\ny: two\n")
    patched, _ = run(spark, edits, "# top\npermissions: write-all  # wide\nx: 1\n")
    assert patched == "# top\npermissions: read-all  # wide\ny: two\nx: 1\n"
    gone = compiled(spark, "a: 1\nb: 2\n", "a: 1\n")
    assert run(spark, gone, "# t\nb: 2  # was\na: 1 # stays\n")[0] == "# t\na: 1 # stays\n"


def test_weak_and_missing_anchors(spark):
    before, after = "jobs:\n  a:\n    steps:\n      - run: x\n", "jobs:\n  a:\n    steps:\n      - run: y\n"
    _, weak = run(spark, compiled(spark, before, after), "jobs:\n  b:\n    steps:\n      - run: x\n")
    assert weak[1].status == "needs_review" and weak[1].reason == "weak anchor" and weak[1].sites == 1
    text, none = run(spark, compiled(spark, before, after), "jobs:\n  b:\n    uses: other\n")
    assert none[1].status == "inapplicable" and text == "jobs:\n  b:\n    uses: other\n"
    scalar = compiled(spark, "permissions: {}\n", "permissions:\n  contents: read\n")
    assert run(spark, scalar, "permissions: read-all\n")[1][1].reason == "container_not_mapping"


def test_postconditions_and_summary(spark):
    edits = compiled(spark).cache()
    pins = [("acme/fetch", "v2", "2" * 40)]
    patched, _ = run(spark, edits, TARGET, pins)
    texts = spark.createDataFrame([("t", TARGET)], "target string, text string")
    pairs = spark.createDataFrame([("p", "t")], "program string, target string")
    pin_rows = spark.createDataFrame(pins, "action string, ref string, sha string")
    judge = lambda text: patches.judge_sites(patches.resolve(edits.join(pairs, "program"), document_nodes(texts.withColumn("text", F.lit(text)), ["target"]), ["program"], ["target"]), pin_rows)
    keys = ["program", "target"]
    outcomes = patches.edit_outcomes(judge(TARGET), keys)
    assert patches.postconditions(outcomes, judge(patched), keys).first().holds
    assert not patches.postconditions(outcomes, judge(TARGET), keys).first().holds
    total = patches.run_summary(outcomes, keys).first()
    assert (total.n_edits, total.n_applied, total.n_created, total.n_needs_review, total.changed, total.fully_applied) == (7, 4, 1, 2, True, False)


@pytest.mark.parametrize("text", ["a: {b: 1, c: 2}\n", "a:\n  b: 1\n  c: |\n    two\n", "a:\n  b: &x 1\n  c: *x\n", "{a: {b: 1}}", "a:\n    b: 'q'"])
def test_rewrite_gives_the_tree_that_was_asked_for(text):
    got = rewrite(text, [(["a"], "set", "b", json.dumps("new: value"), None), (["a"], "set", "z", json.dumps({"k": [1, 2]}), None), (["a"], "remove", "c", None, None)])
    want = yaml.safe_load(text)
    want["a"].update(b="new: value", z={"k": [1, 2]})
    want["a"].pop("c", None)
    assert parse(got) == want


def test_elements_are_nodes_of_their_own(spark):
    """Compiling and resolving look at a document's list elements, not at every step of every path."""
    found = patches._elements(nodes(spark, {"p": AFTER}, ["program"]))
    assert sorted(r.path[-1] for r in found.collect()) == ["[0]", "[1]", "[2]"]


def test_weak_is_what_lies_below_an_unsure_element(spark):
    edits = compiled(spark, "jobs:\n  a:\n    steps:\n      - run: x\n        if: 1\n      - name: n\n        with:\n          k: 1\n", "jobs:\n  a:\n    steps:\n      - run: x\n        if: 2\n      - name: n\n        with:\n          k: 2\n")
    target = nodes(spark, {"t": "jobs:\n  b:\n    steps:\n      - name: n\n        with:\n          k: 1\n      - run: y\n        if: 1\n"}, ["target"])
    pairs = spark.createDataFrame([("p", "t")], "program string, target string")
    sites = patches.resolve(edits.join(pairs, "program"), target, ["program"], ["target"]).collect()
    assert sorted((s.key, s.route, s.weak, s.current) for s in sites) == [("if", "jobs.b.steps[1]", True, "1"), ("k", "jobs.b.steps[0].with", False, "1")]


def test_texts_alike_are_rewritten_once(monkeypatch):
    """Targets of one text and the same steps share what a worker has written; other steps and texts don't."""
    made = []
    monkeypatch.setattr(trees, "rewrite", lambda text, steps: made.append(text) or rewrite(text, steps))
    trees.kept_rewrite.cache_clear()
    one, two = [(((), "set", "a", n, None),) for n in ("1", "2")]
    assert [trees.kept_rewrite(t, s) for t, s in [("a: 0\n", one), ("a: 0\n", one), ("a: 0\n", two), ("a: 5\n", one)]] == ["a: 1\n", "a: 1\n", "a: 2\n", "a: 1\n"]
    assert made == ["a: 0\n", "a: 0\n", "a: 5\n"]
    trees.kept_rewrite.cache_clear()


def test_rows_of_a_small_input_are_not_planned_to_go_through_the_driver(spark, monkeypatch):
    plans, settle = [], patches.settle
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())  # noqa: E731  before it runs: what is broadcast then was measured
    monkeypatch.setattr(patches, "settle", lambda df: planned(df) or settle(df))
    sides = {"before": "concat('a: 1\nb: {x: ', id, '}\n')", "after": "concat('a: ', id + 2, '\nb: {}\n')", "text": "concat('# t\na: 1   # one\nb: {x: ', id, ', y: 2}\n')"}
    docs = spark.range(40).selectExpr("CAST(id AS STRING) AS program", *[f"{text} AS {side}" for side, text in sides.items()])
    edits = patches.compile_edits(*[document_nodes(docs, ["program"], text=c) for c in ("before", "after")], ["program"])
    patched, outcomes = patches.apply_programs(edits, docs.select("program"), docs, document_nodes(docs, ["program"]), ["program"], ["program"])
    found = patched.join(patches.run_summary(outcomes, ["program"]), "program")
    planned(found)
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert {int(r.program): r.patched_text for r in found.collect()} == {n: f"# t\na: {n + 2}   # one\nb: {{y: 2}}\n" for n in range(40)}


def test_rows_of_unknown_size_are_the_same_rows(spark):
    rows = spark.range(20).repartition(3).selectExpr("id", "array(struct(CAST(id AS STRING) AS s)) AS a", "CAST(NULL AS INT) AS n")
    same = unsized(rows)
    assert same.schema == rows.schema and sorted(same.collect()) == sorted(rows.collect()) and same.rdd.getNumPartitions() == 3
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size(rows) < 10_000 and size(settle(same)) > 2**60
