"""Lookups at a forge: keys in partitions, a filter that reaches the source, a limit that tasks share."""

from __future__ import annotations

import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from driftwell.catalog import Catalog
from driftwell.schemas import SCHEMAS
from driftwell.sources.remote import Throttle, lookup, read_through


@pytest.fixture
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            parts = self.path.split("?")[0].split("/")
            body = {"content": base64.b64encode(self.path.encode()).decode(), "sha": parts[3]} if "none" not in self.path else None
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    held = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{held.server_port}", asked
    held.shutdown()


def test_keys_come_from_a_table(spark, server):
    base, asked = server
    keys = spark.range(60).selectExpr("concat('o/r', id % 12) AS repository", "concat('v', id) AS ref", "IF(id = 7, 'none.yml', 'f.yml') AS path")
    keys = keys.unionAll(keys).unionAll(spark.createDataFrame([(None, "v", "f"), ("o/r1", None, "f")], "repository string, ref string, path string"))
    found = lookup(keys, "file_at_ref", base, files=5)
    rows = found.collect()
    assert len(rows) == len(asked) == 60 and sum(r.missing for r in rows) == 1
    assert all(bytes(r.content).decode() == f"/repos/{r.repository}/contents/{r.path}?ref={r.ref}" for r in rows if not r.missing)
    assert found.rdd.getNumPartitions() == 5


def test_a_filter_reaches_the_source(spark, server):
    base, asked = server
    keys = spark.range(60).selectExpr("concat('o/r', 10 + id % 12) AS repository", "concat('v', id) AS ref", "'f.yml' AS path")
    found = lookup(keys, "file_at_ref", base, files=6).filter("repository IN ('o/r11', 'o/r15') AND ref > 'v0'")
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert {r.repository for r in found.collect()} == {"o/r11", "o/r15"} and len(asked) == 10
    assert "PushedFilters" in plan and "o/r15" in plan.split("PushedFilters")[1], plan
    assert found.rdd.getNumPartitions() < 6


def test_a_limit_is_shared(spark, server):
    slept, now = [], [0.0]

    def sleep(s):
        slept.append(s)
        now[0] += s

    throttle = Throttle(4.0, lambda: now[0], sleep)
    for _ in range(5):
        throttle()
    assert now[0] == pytest.approx(1.0) and slept[0] == 0
    Throttle(None)()
    base, asked = server
    keys = spark.range(8).selectExpr("concat('o/r', id) AS repository")
    import time

    began = time.monotonic()
    assert lookup(keys, "repos", base, rate=8.0, files=2).count() == 8
    assert time.monotonic() - began > 0.6 and len(asked) == 8


def test_new_entries_are_kept(spark, server, tmp_path):
    """What the forge was asked for once, an answer or none, isn't asked for again."""
    base, asked = server
    cat, keys = Catalog(spark, str(tmp_path)), ["repository", "ref", "path"]
    wanted = spark.createDataFrame([("o/r", "v1", "f.yml"), ("o/r", "v1", "none.yml")], "repository string, ref string, path string")
    fetch = lambda todo: lookup(todo, "file_at_ref", base, files=1).filter("not missing").drop("missing")
    ask = lambda: read_through(wanted, cat.log("file_at_ref"), keys, fetch, lambda new: cat.append("file_at_ref", new))[0].collect()
    first = sorted((r.path, r.missing) for r in ask())
    assert first == [("f.yml", False), ("none.yml", True)] and len(asked) == 2
    assert sorted((r.path, r.missing) for r in ask()) == first and len(asked) == 2
    assert set(cat.log("file_at_ref").columns) == {c.split()[0] for c in SCHEMAS["file_at_ref"].split(", ")}
