from __future__ import annotations

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from driftwell.functions import columns as c
from driftwell.functions.trees import document_nodes
from driftwell.operators import clusters, diffs, hosts, sampling

KEYED = "array<struct<ident:string,severity:string,confidence:string,route:string>>"


def finding(ident, route):
    return (ident, "high", "sure", route)


def test_sample_is_deterministic_and_grows(spark):
    rows = [("r", f"{i:040x}", "2024", f"f{i}", "n", "o", "M", "True", "True", "") for i in range(200)]
    rows += [("r", "bad", "2024", "f", "n", None, "M", "True", "True", ""), ("r", "bad2", "2024", "f", "n", "o", "A", "True", "True", "")]
    index = spark.createDataFrame(rows, "repository string, commit_hash string, committed_date string, file_path string, file_hash string, previous_file_hash string, git_change_type string, valid_yaml string, valid_workflow string, probably_workflow string")
    take = lambda n, **k: [r.commit_hash for r in sampling.sample_commits(index.repartition(7), n, **k).collect()]
    assert take(20) == take(20) and set(take(20)) < set(take(50)) and len(take(500)) == 200
    held = sampling.sample_commits(index, 50)
    assert not set(take(50, seed=99, exclude=held)) & {r.commit_hash for r in held.collect()}
    assert sampling.distinct_blobs(sampling.file_diffs(held)).count() == 2


def test_clean_fixes_from_scans(spark):
    files = spark.createDataFrame([("r", "a", "f1", "n1", "o1"), ("r", "a", "f2", "n2", "o2"), ("r", "b", "f1", "n3", "o1"), ("r", "c", "f1", "n4", "o1"), ("r", "d", "f9", "nx", "o1")], "repository string, commit_hash string, file_path string, file_hash string, previous_file_hash string")
    f = finding
    scans = spark.createDataFrame(
        [("o1", True, None, [f("x", "jobs.a"), f("y", "on"), f("y", "on")]), ("n1", True, None, [f("y", "on")]), ("o2", True, None, []), ("n2", False, "boom", None), ("n3", True, None, [f("x", "jobs.b"), f("y", "on")]), ("n4", True, None, [f("x", "jobs.a"), f("y", "on")])],
        f"file_hash string, ok boolean, error string, findings {KEYED}",
    )
    found = diffs.file_findings(diffs.join_scans(files, scans))
    commits = {r.commit_hash: r for r in diffs.commit_roll_up(found).collect()}
    assert [tuple(x) for x in commits["a"].V_fixed] == [("x", "jobs.a")] and commits["a"].V_introduced == [] and commits["a"].n_files_modified == 2
    assert commits["b"].V_fixed_idents == ["x"] and [tuple(x) for x in commits["b"].V_introduced] == [("x", "jobs.b")]  # moved: fixed and introduced
    assert commits["d"].V_fixed == [] and commits["d"].files[0].scan_status == "incomplete"
    assert [r.commit_hash for r in diffs.clean_fixes(diffs.commit_roll_up(found)).collect()] == ["a"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from("xyz"), st.sampled_from("pq"))), st.lists(st.tuples(st.integers(0, 3), st.sampled_from("xyz"), st.sampled_from("pq"))))
def test_findings_differ_by_sets(spark, before, after):
    frame = lambda rows: spark.createDataFrame([(k, i, r) for k, i, r in rows], "k int, ident string, route string")
    got = {(r.k, r.ident, r.route, r.side) for r in diffs.diff_findings(frame(before), frame(after), ["k"], ["ident", "route"]).collect()}
    b, a = set(before), set(after)
    assert got == {(*x, "fixed") for x in b - a} | {(*x, "introduced") for x in a - b}


def test_path_maps_and_templates(spark):
    before = "jobs:\n  a:\n    steps:\n      - uses: x/y@v1\n      - run: one\n      - run: one\n    opts: [p, p]\n"
    after = "permissions: {}\njobs:\n  a:\n    steps:\n      - name: new\n        run: in between\n      - uses: x/y@v2\n      - run: one\n      - run: two\n    opts: [p]\n    n: 1\n"
    nodes = lambda text: document_nodes(spark.createDataFrame([("p", text)], "k string, text string"), ["k"], dialect="1.1").filter(~F.col("kind").isin("map", "list")).select("k", c.route_of(F.col("segments")).alias("path"), F.struct("eq", "value", "kind").alias("leaf"))
    got = {r.path: r.change for r in diffs.diff_path_maps(nodes(before), nodes(after), ["k"], equal="eq").collect()}
    assert got == {"jobs.a.steps[name=new~0].name": "added", "jobs.a.steps[name=new~0].run": "added", "jobs.a.steps[uses=x/y~0].uses": "changed", "jobs.a.steps[run~1].run": "changed", "jobs.a.opts['p'~1]": "removed", "jobs.a.n": "added"}
    changes = diffs.diff_path_maps(nodes(before), nodes(after), ["k"], equal="eq").select("k", "path", "change", F.col("old.kind").alias("old_kind"), F.col("new.kind").alias("new_kind"), *[c_.alias(n) for n, c_ in (("old", F.replace(F.col("old.value"), F.lit('"'), F.lit(""))), ("new", F.replace(F.col("new.value"), F.lit('"'), F.lit(""))))])
    lines = clusters.commit_templates(changes, ["k"]).first().template_lines
    assert "~ jobs.a.steps[uses=x/y].uses : uses:x/y@<tag> -> uses:x/y@<tag>" in lines and "- jobs.a.opts[str=*] = str" in lines and "+ jobs.a.n = num" in lines


def test_matching_and_first_k(spark):
    commits = spark.createDataFrame([("r", str(i), "a,b" if i % 2 else "a", f"t{i % 3}") for i in range(12)], "repository string, commit_hash string, fixes string, template_hash string")
    catalog = commits.filter("commit_hash in ('1', '3')")
    got = {r.commit_hash: r.outcome for r in clusters.match_catalog(commits, catalog).collect()}
    assert got["1"] == "full" and got["5"] == "level-1" and got["0"] == "miss"
    top = clusters.cluster(commits, exemplars=1).collect()
    assert all(len(r.exemplars) == 1 for r in top) and sum(r.n_commits for r in top) == 12


def test_columns(spark):
    names = ["release/1", "RELEASES-2", "v1", "v1.2.x", "V2-stable", "stable", "stable-3", "maint", "maintenance/4", "1.2", "1.x-stable", "LTS", "lts_1", "support/x", "release", "feature/x", "version1", "main", "lts2", "v1beta"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.filter(c.is_release_branch(F.col("n"), F.lit("stable"))).collect()] == [n for n in names[:14] if n != "stable"]
    lags = [(-1.0, "same_day_fix", None), (-1.01, "independent_prior_fix", None), (0.0, "same_day_fix", None), (1.0, "same_day_fix", None), (1.01, "true_backport", "1-7 d"), (7.0, "true_backport", "1-7 d"), (30.0, "true_backport", "1-4 w"), (90.0, "true_backport", "1-3 mo"), (365.0, "true_backport", "3-12 mo"), (366.0, "true_backport", ">1 y"), (None, "confirmed_backport_no_lag", None)]
    got = spark.createDataFrame([(x,) for x, _, _ in lags], "l double").select(c.refined_status(F.lit("confirmed_backport"), F.col("l")).alias("s"), c.lag_bucket(F.col("l")).alias("b")).collect()
    assert [(r.s, r.b) for r in got] == [(s, b) for _, s, b in lags]
    scopes = {"jobs.x.steps[2].run": "jobs.x.steps[2]", "jobs.x.steps[2]": "jobs.x.steps[2]", "jobs.x.services.s.image": "jobs.x.services.s", "jobs.x.permissions.contents": "jobs.x", "jobs.x": "jobs.x", "permissions.contents": "", "": ""}
    got = spark.createDataFrame([(r,) for r in scopes], "r string").select(c.scope_of_route(F.col("r")).alias("s")).collect()
    assert [r.s for r in got] == list(scopes.values())


def test_hosts_survive(spark):
    before = "jobs:\n  old:\n    steps:\n      - uses: a/b@v1\n      - uses: c/d@v1\n    services:\n      db: {image: x}\n      web: {image: y}\n  gone:\n    runs-on: z\n"
    after = "jobs:\n  new:\n    steps:\n      - uses: a/b@v2\n    services:\n      db: {image: x}\n"
    sides = [document_nodes(spark.createDataFrame([("p", t)], "k string, text string"), ["k"]) for t in (before, after)]
    at = lambda n, size, where: n.filter((F.size("segments") == size) & (F.col("segments")[0] == "jobs") & where)
    jobs = [at(n, 2, F.lit(True)).select("k", F.col("segments")[1].alias("job"), F.col("ordinal").alias("position")) for n in sides]
    steps = [at(n, 4, F.col("segments")[2] == "steps").select("k", F.col("segments")[1].alias("job"), F.regexp_extract("route", r"\[(\d+)\]$", 1).cast("int").alias("step"), F.regexp_replace(F.col("segments")[3], r"^\[|~\d+\]$", "").alias("identity")) for n in sides]
    services = at(sides[1], 4, F.col("segments")[2] == "services").select("k", F.col("segments")[1].alias("job"), F.col("segments")[3].alias("service"))
    routes = ["jobs.old.steps[0].uses", "jobs.old.steps[1].uses", "jobs.old.steps[9]", "jobs.old.services.db.image", "jobs.old.services.web", "jobs.old", "jobs.gone", "permissions", None]
    findings = spark.createDataFrame([("p", str(i), r) for i, r in enumerate(routes)], "k string, ident string, route string")
    got = {r.ident: r.survived for r in hosts.host_survival(findings, steps[0], steps[1], jobs[0], jobs[1], services, ["k"]).collect()}
    assert [got[str(i)] for i in range(9)] == [True, False, False, True, False, True, False, True, True]
    kinds = hosts.file_kind(spark.createDataFrame([("a", True), ("a", False), ("b", True), ("c", False)], "k string, survived boolean"), ["k"])
    assert {r.k: r.kind for r in kinds.collect()} == {"a": "mixed", "b": "structural", "c": "deletion"}
