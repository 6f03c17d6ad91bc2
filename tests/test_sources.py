from __future__ import annotations

import io
import json
import time
import urllib.error

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from driftwell.catalog import Catalog
from driftwell.schemas import SCHEMAS
from driftwell.sources import remote, scanner, tables
from driftwell.streaming.incremental import distinct_days, drain, progress_of, refresh_every, run_available, stop_on_signal

HEADER = "repository,commit_hash,committed_date,file_path,file_hash,previous_file_hash,git_change_type,valid_yaml,valid_workflow,probably_workflow\n"


def line(commit, new, old):
    return f"o/r,{commit},2024-01-01,f.yml,{new},{old},M,True,True,True\n"


def test_jsonl_and_merges(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"file_hash":"h","ok":true,"findings":[]}\n{broken\n{"file_hash":"g","ok":false,"error":"e"}\n')
    scans = tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "scans")
    assert sorted(r.file_hash for r in scans.collect()) == ["g", "h"]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "scans", strict=True).collect()
    later = spark.createDataFrame([("h", False, "late", None), ("k", True, None, [])], SCHEMAS["scans"])
    assert {r.file_hash: r.ok for r in tables.merge_scans(scans, later).collect()} == {"g": False, "h": False, "k": True}


def test_catalog(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path), "50k")
    assert cat.read("repos").count() == 0
    for name in ("main", "trunk"):
        cat.replace("repos", spark.createDataFrame([("o/r", name)], SCHEMAS["repos"]))
    assert [tuple(r) for r in cat.read("repos").collect()] == [("o/r", "trunk")] and Catalog(spark, str(tmp_path), "10k").read("repos").count() == 0


def test_scanner(spark):
    blobs = spark.createDataFrame([("a", b"x y"), ("a", b"x y"), ("b", None), ("c", b"bad"), ("d", b"done")], "file_hash string, content binary")

    def checker(content):
        if content == b"bad":
            raise ValueError("no good " * 100)
        return [{"ident": w} for w in content.decode().split()]

    done = spark.createDataFrame([("d", True), ("c", False)], "file_hash string, ok boolean")
    got = {r.file_hash: r for r in scanner.scan(blobs, checker, done, partitions=2).collect()}
    assert sorted(got) == ["a", "b", "c"] and [f.ident for f in got["a"].findings] == ["x", "y"]
    assert not got["b"].ok and not got["c"].ok and len(got["c"].error) == 200
    assert scanner.command(["cat"])(b'[{"ident": "z"}]') == [{"ident": "z"}]
    with pytest.raises(ValueError, match="exit 3"):
        scanner.command(["sh", "-c", "exit 3"])(b"")


class Answer(io.BytesIO):
    def __init__(self, body, link=None):
        super().__init__(json.dumps(body).encode())
        self.headers = {"Link": link} if link else {}


def test_remote_pages_waits_and_misses():
    calls, waits = [], []

    def opener(request, timeout):
        calls.append(request.full_url)
        if len(calls) == 1:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {}, None)
        if "missing" in request.full_url:
            raise urllib.error.HTTPError(request.full_url, 404, "none", {}, None)
        return Answer([1], '<http://x/2>; rel="next", <http://x/9>; rel="last"')

    assert remote.get_json("http://x/1", "t", opener, waits.append) == ([1], "http://x/2") and waits == [1.0]
    assert remote.get_json("http://x/missing", "", opener, waits.append) == (None, None)
    assert remote.next_link(None) is None


def test_forge_is_off_without_an_address(spark):
    remote.register(spark)
    with pytest.raises(Exception, match="forge is off"):
        spark.read.format("forge").option("table", "branches").option("repositories", '["a/b"]').load().collect()


def test_cache_with_negative_entries(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    cache = spark.createDataFrame([("a", "v", False), ("b", None, True)], "k string, v string, missing boolean")
    known, todo = remote.with_cache(wanted, cache, ["k"])
    assert sorted(r.k for r in known.collect()) == ["a", "b"] and [r.k for r in todo.collect()] == ["c"]
    assert remote.decode_content(spark.createDataFrame([("aGkg\nIQ==",)], "content_base64 string")).first().content == b"hi !"


def test_export_names(spark):
    clean = spark.createDataFrame([("o/r", "0123456789ab", [("a/x.yml", "o", "n", "ok", [], []), ("a/x.yaml", "o", "zz", "ok", [], [])])], f"repository string, commit_hash string, files array<struct<file_path:string,previous_file_hash:string,file_hash:string,scan_status:string,V_fixed:array<string>,V_introduced:array<string>>>")
    texts = spark.createDataFrame([("o", "old"), ("n", "new")], "file_hash string, text string")
    got = {(r.dir, r.name): r.text for r in tables.commit_export(clean, texts).collect()}
    d = "o__r__0123456789"
    assert got == {(d, "before__a__x.yml"): "old", (d, "after__a__x.yml"): "new", (d, "before__a__x.1.yml"): "old", (d, "after__a__x.1.yml"): "# missing blob\n"}


def driver(spark, tmp_path, texts, known=True):
    """Runs of the incremental driver over tmp_path/index; its catalog. Findings: a line "bad NAME" is one at its route."""
    cat, held = Catalog(spark, str(tmp_path / "out")), spark.createDataFrame(list(texts.items()), "file_hash string, text string")

    def check(content):
        if b"broken" in content:
            raise ValueError("can't be read")
        return [{"ident": line.split()[2], "route": line.split()[3]} for line in content.decode().splitlines() if line.startswith("# bad")]

    for name, rows in (("repos", [("o/r", "main")]), ("branches", [("o/r", "v1", "h")]), ("commit_on_branch", [("o/r", "main", f"c{i}", True) for i in range(9)])):
        cat.replace(name, spark.createDataFrame(rows if known else [], SCHEMAS[name]))
    scans = lambda hashes: scanner.scan(held.select("file_hash", F.encode("text", "UTF-8").alias("content")).join(hashes, "file_hash", "right"), check)

    def run(files_per_batch=1000, texts_of=None, **options):
        return run_available(spark, str(tmp_path / "index"), cat, scans, texts_of or (lambda hashes: held.join(hashes, "file_hash", "left_semi")), str(tmp_path / "state"), files_per_batch, **options)

    (tmp_path / "index").mkdir()
    return cat, run, lambda: sorted((r.commit_hash, r.outcome, r.reason) for r in cat.log("outcomes").collect())


GOOD, BAD, WORSE = "on: push\n", "# bad x on\non: push\n", "# bad z on\non: push\n"


def test_incremental_driver_resumes_and_adds_no_doubles(spark, tmp_path):
    cat, run, outcomes = driver(spark, tmp_path, {"o1": BAD, "n1": GOOD, "o2": GOOD, "n2": WORSE, "o3": BAD})
    (tmp_path / "index" / "1.csv").write_text(HEADER + line("c1", "n1", "o1") + line("c2", "n2", "o2"))
    run()
    (tmp_path / "index" / "2.csv").write_text(HEADER + line("c1", "n1", "o1") + line("c3", "n9", "o3"))
    run()
    run()
    assert outcomes() == [("c1", "audited", None), ("c2", "not_clean_fix", "no_v_fixed"), ("c3", "blob_missing", None)]
    assert cat.log("gaps").count() == 1 and cat.log("clean_fix_meta").count() == 1 and cat.log("export").count() == 2


def test_a_commit_spread_over_batches_is_judged_whole(spark, tmp_path):
    cat, run, outcomes = driver(spark, tmp_path, {"o1": BAD, "n1": GOOD, "o2": GOOD, "n2": WORSE})
    (tmp_path / "index" / "1.csv").write_text(HEADER + line("c1", "n1", "o1"))
    run(1)
    assert outcomes() == [("c1", "audited", None)]
    (tmp_path / "index" / "2.csv").write_text(HEADER + line("c1", "n1", "o1") + line("c1", "n2", "o2").replace("f.yml", "g.yml"))
    run(1)
    assert outcomes() == [("c1", "not_clean_fix", "v_introduced_nonempty")]
    assert cat.log("workflow_index").count() == 2


def test_every_outcome_is_reached(spark, tmp_path):
    before = "# bad p jobs.a.steps[0].run\njobs:\n  a:\n    steps:\n      - run: x\n"
    gone = "jobs:\n  b:\n    steps:\n      - name: y\n        run: z\n"
    cat, run, outcomes = driver(spark, tmp_path, {"o1": BAD, "n1": GOOD, "o2": before, "n2": gone, "o3": BAD, "o4": GOOD, "n4": GOOD, "o5": BAD, "n5": "broken"})
    lost = {"on": True}

    def texts_of(hashes):
        if lost["on"]:
            raise RuntimeError("the store is away")
        return spark.createDataFrame([("o1", BAD), ("n1", GOOD), ("o2", before), ("n2", gone), ("o4", GOOD), ("n4", GOOD)], "file_hash string, text string").join(hashes, "file_hash", "left_semi")

    (tmp_path / "index" / "1.csv").write_text(HEADER + line("c1", "n1", "o1") + line("c2", "n2", "o2") + line("c3", "n1", "o3") + line("c4", "n4", "o4") + line("c5", "n5", "o5"))
    run(texts_of=texts_of)
    assert {x[1] for x in outcomes()} == {"exception"} and cat.log("outcomes").filter("error like '%store is away%'").count() == 5
    lost["on"] = False
    (tmp_path / "index" / "2.csv").write_text(HEADER + line("c9", "n1", "o1"))  # not on the default branch
    run(texts_of=texts_of)
    assert outcomes() == [("c1", "audited", None), ("c2", "host_removed", None), ("c3", "blob_missing", None), ("c4", "not_clean_fix", "no_v_fixed"), ("c5", "blob_missing", None), ("c9", "audit_failed", "not_on_default")]
    assert {r.kind for r in cat.log("classification").filter("commit_hash = 'c2'").collect()} == {"deletion"} and cat.log("diffs").filter("commit_hash = 'c2'").count() == 1


def test_stream_equals_batch(spark, sf_dir):
    q = entry.queries()
    rows = lambda n: sorted(map(tuple, q[n](spark, sf_dir).select("event_type", "n_low", "n_middle", "n_high").collect()))
    assert rows("stream_available_now") == rows("rule_status_crosstab")


def test_entry(spark):
    assert entry.entry(spark).filter(F.col("n_fixed") > 0).count() == 60
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_refresh_runs_and_drains(spark):
    runs = []
    query = refresh_every(spark, lambda: runs.append(1), "1 second")
    end = time.monotonic() + 60
    while not runs and time.monotonic() < end:
        time.sleep(0.2)
    assert drain(query) and runs and not query.isActive


def test_days_of_event_streams(spark, sf_dir, tmp_path):
    events = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events*").parquet(sf_dir)
    query = distinct_days(events).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts"), "user_id", "event_type").distinct().count()
    assert spark.table("days").count() == batch


def test_first_signal_drains(spark):
    import os
    import signal

    clock = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    query = clock.writeStream.foreachBatch(lambda rows, n: None).trigger(processingTime="1 second").start()
    undo = stop_on_signal(query)
    end = time.monotonic() + 60
    while not query.lastProgress and time.monotonic() < end:
        time.sleep(0.2)
    rows, rate, left = progress_of(query, 10**6)
    assert rows >= 0 and rate >= 0 and (left is None or left > 0)
    os.kill(os.getpid(), signal.SIGINT)
    while query.isActive and time.monotonic() < end:
        time.sleep(0.2)
    undo()
    assert not query.isActive


def test_later_writers_win_and_pointers_can_be_thinned(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    for name in "abc":
        cat.replace("repos", spark.createDataFrame([("o/r", name)], SCHEMAS["repos"]))
    assert cat.versions("repos", keep=1) == 1 and cat.read("repos").first().default_branch == "c"
