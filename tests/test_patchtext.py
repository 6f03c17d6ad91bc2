from __future__ import annotations

from pyspark.sql import functions as F

from driftwell.functions import patchtext
from driftwell.operators import generators

EDITS = [
    ("ensure_present", ["jobs", "$JOB", "steps", "[uses=acme/fetch]", "with"], "version", '"3.10"', None, None, None),
    ("ensure_present", ["jobs", "$JOB", "steps", "[uses=acme/fetch]", "with"], "multi", '"a\\nb: c # d"', None, None, None),
    ("ensure_absent", [], "env", None, None, None, None),
    ("rewrite_value", ["jobs", "$JOB", "steps", "[run]"], "run", '"make test"', None, "str", None),
    ("rewrite_value", [], "empty", "null", None, "null", None),
    ("rewrite_value", ["jobs", "$JOB"], "secrets", '{"A": [1, 2]}', None, "perm:inherit", None),
    ("rewrite_value", ["jobs", "$JOB", "steps", "[uses=a/b.c]"], "uses", None, "a/b.c", "uses:a/b.c@<tag>", None),
    ("ensure_present", ["jobs", "$JOB", "steps", "[name=x]"], "run", '"y"', None, None, "adds a list element"),
]
SCHEMA = "program string, ordinal int, op string, anchor array<string>, key string, value string, pin_action string, expected_old string, review string"


def test_round_trip_of_executable_edits(spark):
    edits = spark.createDataFrame([("p", i, *e) for i, e in enumerate(EDITS)], SCHEMA)
    heads = spark.createDataFrame([("p", "o/r", "abc", "a b.yml", ["r2", "r1"])], "program string, repository string, commit_hash string, source_file string, target_idents array<string>")
    texts = patchtext.render(heads, edits)
    text = texts.first().text
    assert text.startswith("@@\n# source: o/r@abc a b.yml\nfixes r2, r1\nmetavariable job $JOB\n@@\n\njobs.$JOB.steps[uses=acme/fetch].with\n+ version: \"3.10\"\n")
    assert "#   jobs.$JOB.steps[name=x].run  ->  adds a list element" in text and "+ run: make test" in text
    programs, back = patchtext.read(texts)
    assert programs.first()[:] == ("p", "o/r", "abc", "a b.yml", ["r2", "r1"])
    got = {(r.op, tuple(r.anchor), r.key, r.value, r.pin_action) for r in back.collect()}
    assert got == {(e[0], tuple(e[1]), e[2], e[3], e[4]) for e in EDITS if not e[6]}
    assert patchtext.render(heads, back.withColumn("ordinal", F.col("ordinal"))).first().text.split("\n\n# ---")[0] == text.split("\n\n# ---")[0] + ("" if "# ---" not in text else "\n")


def test_segments(spark):
    rows = spark.createDataFrame([("jobs.a.steps[uses=x/y.z~0].with[a[1]~2]", 0), ("on", 1), ("$V[run~1]", 2)], "p string, i int").select("i", patchtext.path_segments(F.col("p")).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == [["jobs", "a", "steps", "[uses=x/y.z~0]", "with", "[a[1]~2]"], ["on"], ["$V", "[run~1]"]]
    part = spark.createDataFrame([(s,) for s in ("[uses=a/b~0]", "[run~3]", "['x'~0]", "[#2~0]", "[True~0]", "$JOB", "k")], "s string").select(patchtext.segment_parts(F.col("s")).alias("p")).collect()
    assert [tuple(r.p) for r in part] == [("list", "uses", "a/b"), ("list", "run", ""), ("list", "str", "x"), ("list", "index", "#2"), ("list", "scalar", "True"), ("keyvar", None, "JOB"), ("key", None, "k")]


def test_hunks():
    before, after = "a\nb\nc\nd\n", "a\nB\nc\nd\n"
    assert generators.replay_hunk(before, after, "x\nb\ny\n") == ("x\nB\ny\n", "applied")
    assert generators.replay_hunk(before, after, "b\nb\n") == ("b\nb\n", "ambiguous")
    assert generators.replay_hunk(before, after, "z\n") == ("z\n", "not_found")
    assert generators.replay_hunk(before, before, "z\n") == ("z\n", "unchanged")
    assert generators.replay_hunk("a\nb\n", "a\nnew\nb\n", "0\na\n1\n") == ("0\na\nnew\n1\n", "applied")
    assert generators.replay_hunk("a\n", "new\na\n", "0\na\n") == ("0\nnew\na\n", "applied")


def test_bumps(spark):
    from driftwell.functions.trees import document_nodes, parse
    from driftwell.operators.patches import patched_texts

    doc = lambda ref: f"jobs:\n  j:\n    steps:\n      - uses: a/b@{ref}\n      - uses: c/d@v1\n"
    rows = spark.createDataFrame([("p", doc("v1"), doc("v2"), doc("v0"))], "program string, before string, after string, text string")
    sides = [document_nodes(rows, ["program"], text=c) for c in ("before", "after", "text")]
    bumps = generators.version_bumps(sides[0], sides[1], ["program"])
    assert [tuple(r) for r in bumps.collect()] == [("p", "a/b", "v2")]
    sites = generators.bump_sites(bumps, sides[2], rows.select("program"), ["program"], ["program"])
    got = patched_texts(rows.select("program", "text"), sites, ["program"], ["program"]).first().patched_text
    assert parse(got) == parse(doc("v2"))


COMMENTED = """# top
on: push # when
permissions: write-all # wide
jobs: # all
  a: # first
    # before steps
    secrets: inherit # old
    env: {A: 1, B: two}
    script: |
      one
      two
    steps: # s
      - uses: x/y@v1 # pin me
        with: # opts
          k: v
          # last
      - run: b # run
        name: n
  # between
  b:
    only: 1
# end
"""


def test_edits_in_place_keep_comments():
    """Complex values, nested keys, blocks and block scalars: only what is removed or replaced loses its comments."""
    import json

    from driftwell.functions.trees import parse, rewrite

    comments = ["# top", "# when", "# wide", "# all", "# first", "# before steps", "# old", "# s", "# pin me", "# opts", "# last", "# run", "# between", "# end"]
    cases = [
        ("jobs.a", "set", "secrets", {"t": "x", "u": [1, 2]}, []), ("jobs.a", "remove", "env", None, []), ("jobs.a.env", "set", "C", 3, []), ("jobs.a", "set", "script", "a\nb", []),
        ("jobs.a", "remove", "script", None, []), ("jobs.a.steps[0]", "remove", "with", None, ["# opts"]), ("jobs.a.steps[1]", "remove", "run", None, ["# run"]), ("jobs.b", "remove", "only", None, []),
        ("jobs.a.steps[0]", "set", "with", {"q": 1}, []), ("jobs.a.steps[0].with", "set", "z", True, []), ("", "set", "permissions", {"contents": "read"}, []), ("jobs.b.deep.er", "set", "k", "v", []),
        ("jobs.a", "set", "steps", [], ["# pin me", "# opts", "# last", "# run"]), ("", "set", "defaults", {"run": {"shell": "bash"}}, []), ("jobs.a.steps[0]", "remove", "uses", None, ["# pin me"]),
    ]
    for route, op, key, value, lost in cases:
        path = [x for x in route.replace("[", ".[").split(".") if x]
        out = rewrite(COMMENTED, [(path, op, key, None if value is None else json.dumps(value), None)])
        assert [c for c in comments if c not in out] == lost, (route, key)
        place = parse(out)
        for part in path:
            place = place[int(part[1:-1])] if part[0] == "[" else place[part]
        assert place.get(key) == value and (op == "set") == (key in place)
    assert rewrite("a: &x\n  b: 1\nc: *x\n", [(["a"], "set", "b", "2", None)]).count("2") >= 1
