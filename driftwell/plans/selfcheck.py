"""The patch engine's own check: small documents whose right answers are known, run through the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.trees import document_nodes
from ..operators import chain, patches
from ..operators.lineage import settle
from ..operators.scopes import enclosing

#: Scenarios: (name, before, after, target, words that the patched text must have, words that it must not have).
SCENARIOS = (
    ("pin", "jobs:\n  a:\n    steps:\n      - uses: x/y@v1\n", f"jobs:\n  a:\n    steps:\n      - uses: x/y@{'1' * 40}\n", "jobs:\n  z: # kept\n    steps:\n      - run: first\n      - uses: x/y@v2\n", (f"x/y@{'2' * 40} # v2", "# kept"), ("x/y@v2",)),
    ("permission", "permissions: write-all\non: push\n", "permissions: read-all\non: push\n", "# top\non: push\npermissions: write-all\n", ("# top", "permissions: read-all"), ("write-all",)),
    ("missing key", "jobs:\n  a:\n    steps:\n      - uses: x/y@v1\n", "jobs:\n  a:\n    timeout-minutes: 5\n    steps:\n      - uses: x/y@v1\n", "jobs:\n  b:\n    runs-on: big\n    steps:\n      - uses: x/y@v1\n", ("timeout-minutes: 5", "runs-on: big"), ()),
    ("removal", "jobs:\n  a:\n    secrets: inherit\n    uses: o/w@v1\n", "jobs:\n  a:\n    uses: o/w@v1\n", "jobs:\n  c:\n    secrets: inherit\n    uses: o/w@v1 # kept\n", ("uses: o/w@v1 # kept",), ("inherit",)),
    ("scalar to map", "jobs:\n  a:\n    secrets: inherit\n    uses: o/w@v1\n", "jobs:\n  a:\n    secrets:\n      token: t\n    uses: o/w@v1\n", "# top\njobs:\n  c:\n    secrets: inherit # old\n    uses: o/w@v1 # kept\n", ("token: t", "# top", "# kept"), ("inherit",)),
)
#: Fixed values: (route, scope, whether the route lies in it).
SCOPES = (
    ("jobs.a.steps[1].with.x", "jobs.a.steps[1]", True), ("jobs.a.steps[10]", "jobs.a.steps[1]", False), ("jobs.a.steps[1]", "jobs.a", True), ("jobs.ab", "jobs.a", False),
    ("jobs.a.services.db.image", "jobs.a.services.db", True), ("jobs.a.services.other", "jobs.a.services.db", False), ("on.push", "", True), ("jobs.a", "jobs.a.steps[1]", False),
)


def run(spark: SparkSession) -> DataFrame:
    """(name, passed) of every scenario, of running each patched text again, and of the scopes."""
    docs = spark.createDataFrame([s[:4] for s in SCENARIOS], "program string, before string, after string, target_text string")
    edits = patches.compile_edits(*[document_nodes(docs, ["program"], text=c) for c in ("before", "after")], ["program"])
    pins = spark.createDataFrame([("x/y", "v2", "2" * 40)], "action string, ref string, sha string")
    targets = docs.select("program", F.col("program").alias("target"), F.col("target_text").alias("text"))
    _, _, patched = chain.patch_run(targets, edits, pins)
    patched = settle(patched)
    again = patched.select("program", "target", F.col("patched_text").alias("text"))
    _, _, twice = chain.patch_run(again, edits, pins)
    words = spark.createDataFrame([(s[0], list(s[4]), list(s[5])) for s in SCENARIOS], "program string, must array<string>, mustnt array<string>")
    holds = F.forall("must", lambda w: F.col("patched_text").contains(w)) & ~F.exists("mustnt", lambda w: F.col("patched_text").contains(w))
    first = patched.join(words, "program").select(F.col("program").alias("name"), holds.alias("passed"))
    still = twice.select(F.concat(F.col("program"), F.lit(", again")).alias("name"), (~F.col("text_changed")).alias("passed"))
    routes = spark.createDataFrame(list(SCOPES), "route string, scope string, inside boolean")
    scoped = routes.select(F.concat_ws(" in ", "route", "scope").alias("name"), (F.array_contains(enclosing(F.col("route")), F.col("scope")) == F.col("inside")).alias("passed"))
    return first.unionAll(still).unionAll(scoped).orderBy("name")
