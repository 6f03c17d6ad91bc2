"""Edits of the source text: what no edit names stays byte for byte."""

from __future__ import annotations

import json
import random

import pytest
import yaml

from driftwell.functions import syntax
from driftwell.functions.syntax import document_tokens, load, read
from driftwell.functions.trees import parse, rewrite

WORKFLOW = """\
# a service
x-base: &base   # shared
  retries: 3
  mode: 0755
services:
  db:
    ports: [ 22:22, "80:80" ]   # both
    since: 2024-01-01
    total: 1_000
    <<: *base
  "web.front":
    image: 'nginx'   # keep
    env.x: {a: 1,  b: "two"}
    command: |+
      one

      two

    ports:
      - 22:22
      - 0o17
env:
  x: {a: 9}
copy: *base
on: push
"""


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("22:22", "22:22"), ("1_000", "1_000"), ("2024-01-01", "2024-01-01"), ("0755", 755), ("0o755", 493), ("0x1F", 31), ("-7", -7), ("+7", 7), ("1e3", 1000.0), (".5", 0.5), ("1.", 1.0),
        ("-.inf", float("-inf")), ("yes", "yes"), ("on", "on"), ("True", True), ("~", None), ("", None), ("null", None), ("0b1", "0b1"), ("190:20:30", "190:20:30"), ("!!str 5", "5"), ("!own 5", "5"), ("!own {a: 1}", {"a": 1}), ("=", "="),
    ],
)
def test_scalars_of_the_core_schema(text, value):
    got = parse(f"k: {text}\n")["k"]
    assert got == value and type(got) is type(value)


def test_streams_and_recursion():
    assert parse("a: 1\n---\nb: 2\n") is None and parse("a: 1\n---\nb: 2\n", document=1) == {"b": 2}
    assert parse("&a [*a]") is None and parse("a: &x [1]\nb: *x\n") == {"a": [1], "b": [1]}
    assert parse("a: [") is None and parse("a: *x") is None and parse("") is None


def edited(path, op, key, value=None, text=WORKFLOW, **kw):
    return rewrite(text, [(path, op, key, None if op == "remove" else json.dumps(value), None)], **kw)


@pytest.mark.parametrize(
    ("path", "op", "key", "value", "old", "new"),
    [
        ([], "set", "on", "pull", "on: push", "on: pull"),
        ([], "set", "permissions", {"contents": "read"}, "  mode: 0755\n", "  mode: 0755\npermissions:\n  contents: read\n"),
        (["x-base"], "set", "timeout", 5, "  retries: 3\n", "  retries: 3\n  timeout: 5\n"),
        (["services", "db"], "set", "since", "2025-02-02", "2024-01-01", "'2025-02-02'"),
        (["services", "db"], "set", "ports", "8:8", ' [ 22:22, "80:80" ]   # both', " '8:8'   # both"),
        (["services", "db"], "set", "retries", 4, "# both\n", "# both\n    retries: 4\n"),
        (["services", "db"], "remove", "total", None, "    total: 1_000\n", ""),
        (["services", "web.front"], "set", "image", "caddy", "'nginx'", "caddy"),
        (["services", "web.front", "env.x"], "set", "c", "p, q", 'b: "two"', "b: \"two\", c: 'p, q'"),
        (["services", "web.front", "env.x"], "remove", "a", None, "a: 1,  ", ""),
        (["services", "web.front", "env.x"], "remove", "b", None, ',  b: "two"', ""),
        (["env", "x"], "set", "a", "#", "a: 9", "a: '#'"),
        (["env"], "set", "y.z", "on", "  x: {a: 9}\n", "  x: {a: 9}\n  y.z: 'on'\n"),
        (["env", "deep", "er"], "set", "k", True, "  x: {a: 9}\n", "  x: {a: 9}\n  deep:\n    er:\n      k: true\n"),
        (["copy"], "set", "mode", 8, "0755", "8"),  # an alias is what it names
    ],
)
def test_an_edit_changes_its_entry_alone(path, op, key, value, old, new):
    assert WORKFLOW.count(old) == 1
    assert edited(path, op, key, value) == WORKFLOW.replace(old, new)


def test_an_anchor_that_is_still_named_moves():
    text = edited([], "remove", "x-base")
    assert "<<: &base {retries: 3, mode: 755}" in text and "copy: *base" in text and text.startswith("# a service\nservices:")
    assert load(text)[0] == {k: v for k, v in load(WORKFLOW)[0].items() if k != "x-base"}
    assert edited([], "set", "a", 2, text="a: &x one   # first\nb: *x\nc: *x\n") == "a: 2   # first\nb: &x one\nc: *x\n"


def test_an_entry_given_by_a_merge_can_go():
    text = edited(["services", "db"], "remove", "mode")
    assert text == WORKFLOW.replace("    <<: *base\n", "    retries: 3\n")


def test_several_documents_are_edited_one_at_a_time():
    text = "# one\na: 22:22\n--- # two\na: 1\n...\n---\nz: [1]\n"
    assert edited([], "set", "a", 2, text=text, document=1) == text.replace("a: 1", "a: 2")
    assert edited([], "set", "a", 2, text=text) == text


@pytest.mark.parametrize(
    ("text", "op", "path", "key", "value", "want"),
    [
        ("a: {}\n", "set", ["a"], "b", 1, "a: {b: 1}\n"),
        ("a:\n  b: 1  # only\nc: 2\n", "remove", ["a"], "b", None, "a: {}  # only\nc: 2\n"),
        ("a: # note\n  b: 1\nc: 2\n", "remove", ["a"], "b", None, "a: {} # note\nc: 2\n"),
        ("- a: 1\n  b: 2\n- c: 3\n", "remove", ["[0]"], "a", None, "- b: 2\n- c: 3\n"),
        ("- a: 1\n- c: 3\n", "remove", ["[0]"], "a", None, "- {}\n- c: 3\n"),
        ("a: |+\n  x\n\n\n", "set", [], "b", 1, "a: |+\n  x\n\n\nb: 1\n"),
        ("a: 1", "set", [], "b", 1, "a: 1\nb: 1\n"),
        ("1: x\nfalse: y\n", "set", [], "1", "z", "1: z\nfalse: y\n"),
        ("a:\nb: 1\n", "set", [], "a", 2, "a: 2\nb: 1\n"),
        ("? a\n: 1\n? b\n: 2\n", "set", [], "a", 5, "? a\n: 5\n? b\n: 2\n"),
        ("a: {b: 1,}\n", "set", ["a"], "c", 2, "a: {b: 1, c: 2,}\n"),
        ("\ufeffa: 1 # é\nb: 2\n", "set", [], "b", 3, "\ufeffa: 1 # é\nb: 3\n"),
        ("a: >\n  folded\n  text\n\n# end\n", "set", [], "a", "x", "a: x\n\n# end\n"),
        ("a: 1\r\nb: 2\r\n", "set", [], "a", 7, "a: 7\r\nb: 2\r\n"),
    ],
)
def test_forms(text, op, path, key, value, want):
    assert edited(path, op, key, value, text=text) == want


def test_many_edits_give_the_tree_that_was_asked_for():
    """Whatever the edit, the tree read again is the one asked for, and text outside of one region stays."""
    rng = random.Random(8)
    places = [[], ["x-base"], ["services"], ["services", "db"], ["services", "web.front"], ["services", "web.front", "env.x"], ["env"], ["env", "x"]]
    for _ in range(300):
        path = rng.choice(places)
        tree = load(WORKFLOW)[0]
        for p in path:
            tree = tree[p]
        key = rng.choice([*map(str, tree), "new", "n.k", "a b", "22:22"])
        op, value = rng.choice(["set", "remove"]), rng.choice([1, "x: y", "0755", None, True, 1.5, {"k": [1, {"z": "#"}]}, [], {}, "two\nlines"])
        got = edited(path, op, key, value)
        own = syntax.entry_of(syntax.locate(read(WORKFLOW)[0], path), key)
        loader = syntax.Unmerged if op == "set" or own else syntax.Core  # what a merge gives can only go if that is written out
        want = load(WORKFLOW, loader)[0]
        place = want
        for p in path:
            place = place[p]
        place.update({key: value}) if op == "set" else place.pop(key, None)
        assert load(got, loader)[0] == want, (path, op, key, value, got)
        if key != "x-base":  # an anchor that goes moves
            node = syntax.locate(read(WORKFLOW)[0], path)
            line_end = WORKFLOW.find("\n", node.end) + 1 or len(WORKFLOW)
            assert got.startswith(WORKFLOW[: node.start - 20 if node.start > 20 else 0]) and got.endswith(WORKFLOW[line_end:])


def test_tokens_cover_the_text(spark):
    rows = spark.createDataFrame([(1, WORKFLOW), (2, "a: ["), (3, None), (4, "a: 1\n---\n- &b x\n- *b\n")], "k long, text string")
    got = document_tokens(rows, ["k"]).collect()
    assert {r.k for r in got} == {1, 4}
    for r in got:
        source = WORKFLOW if r.k == 1 else "a: 1\n---\n- &b x\n- *b\n"
        piece = source[r.start : r.end]
        if r.kind == "scalar" and not r.style and not r.anchor:
            assert piece == r.value
        if r.kind == "alias":
            assert piece == f"*{r.alias}"
        assert source.split("\n")[r.line][r.column :].startswith(piece.split("\n")[0])
    assert [(r.document, r.path, r.value) for r in got if r.k == 4 and r.kind == "scalar"] == [(0, ["a"], "a"), (0, ["a"], "1"), (1, ["[0]"], "x")]
    assert len(read(WORKFLOW)) == 1 and syntax.locate(read(WORKFLOW)[0], ["services", "db", "mode"]).text == "0755"


@pytest.mark.parametrize("text", ["", "a: b", "on: push\njobs:\n  main:\n    steps:\n      - uses: a/b@v1 # pin\n      - run: |\n          make\n\n      - run: echo ${{ x.y }}\n  other:\n", "a: 'q'\nb: \"w\\n\"\nc: &x d\ne: *x\n<<: *x\n", "- \n-  - a\n   - b\n", "a: >-\n  b\n\n  c\n# end\n"])
def test_libyaml_reads_plain_texts_alike(text):
    """Texts that it is trusted with give the events of PyYAML's own parser, places included."""
    assert syntax.ALIKE.fullmatch(text)
    told = lambda events: [(type(e), getattr(e, "value", None), getattr(e, "implicit", None), getattr(e, "anchor", None), getattr(e, "style", None) or "", e.start_mark.index, e.end_mark.index) for e in events]
    assert told(syntax.events_of(text)) == told(yaml.parse(text, Loader=syntax.Core))
    assert not yaml.__with_libyaml__ or syntax.events_of(text)[0].start_mark.buffer is None


@pytest.mark.parametrize("text", ["? a", "{b: }", "a: !t b", "%YAML 1.2\n---\na: b", "﻿a: b", "1\t", "a: >#_", "a: é", "a: [b]"])
def test_libyaml_is_kept_from_other_texts(text):
    assert not syntax.ALIKE.fullmatch(text)


def test_rewrite_makes_values_once_for_each_text(monkeypatch):
    made, values = [], syntax.Parsed.values
    monkeypatch.setattr(syntax.Parsed, "values", lambda self, *a: made.append(self.text) or values(self, *a))
    steps = [([], "set", "a", "1", None), ([], "set", "b", "2", None), ([], "remove", "c", None, None)]
    assert rewrite("a: 0\nc: 3\n", steps) == "a: 1\nb: 2\n"
    assert len(made) == len(set(made)) == 4


def told(read, text):
    try:
        return repr(read(text))
    except (yaml.YAMLError, ValueError, RecursionError, KeyError) as e:
        return type(e).__name__


def test_values_of_plain_texts_are_those_of_pyyaml():
    """libyaml's composer under Core's rules, on random texts; deep, shared and unreadable ones are among them."""
    rng = random.Random(5)
    pieces = ["a", "b: ", "- ", "\n", "\n  ", "\n    ", ": ", "0755", "0o17", "0x1F", "1_000", "1.5e3", ".inf", "yes", "true", "null", "~", "<<: ", "&x ", "*x", "'q'", '"w\\n"', " # c", "2024-01-01", "22:22", "|\n  ", "-\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(4000)]
    texts += ["- " * n + "a" for n in (20, 31, 32, 33, 400)] + ["\n".join(" " * i + "k:" for i in range(n)) for n in (60, 70, 400)] + ["", "a: " + "9" * 5000, "a: 1\na: 2\n", "1: a\n'1': b\n"]
    for text in texts:
        assert told(load, text) == told(lambda t: syntax.Parsed(t).values(syntax.Core), text), text


@pytest.mark.skipif(not yaml.__with_libyaml__, reason="no libyaml")
def test_values_of_plain_texts_are_composed_by_libyaml(monkeypatch):
    monkeypatch.setattr(syntax, "Parsed", None)  # events as Python objects, composed in Python
    assert load("permissions: write-all\njobs:\n  main:\n    steps:\n      - uses: a/b@v1 # pin\n        n: 0755\n") == [{"permissions": "write-all", "jobs": {"main": {"steps": [{"uses": "a/b@v1", "n": 755}]}}}]
