"""Patches, hunk replay and a file stream, on workflow-like documents made from the driver's tables.

The documents are made of a template whose right answers are known for every row, so SQL can give them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import patchtext
from ..functions.trees import document_nodes
from ..operators import generators, patches
from ..operators.lineage import shared_folder
from . import analytics
from .tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(program, before, after, target): a document for each supplier, its fix, and a drifted version of it."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("program"), "s_nationkey")
    step = lambda v: F.concat(F.lit("      - uses: acme/fetch@"), v, F.lit("\n      - name: build\n        run: make s"), "program", F.lit("\n"))
    head = lambda p, job: F.concat(F.lit("# supplier "), "program", F.lit("\npermissions: "), F.lit(p), F.lit("\njobs:\n  "), job, F.lit(":\n    runs-on: n"), F.col("s_nationkey").cast("string"), F.lit("\n"))
    before = F.concat(head("write-all", F.lit("main")), F.lit("    steps:\n"), step(F.lit("v3")))
    after = F.concat(head("read-all", F.lit("main")), F.lit("    timeout-minutes: 10\n    steps:\n"), step(F.lit("1" * 40)))
    target = F.concat(head("write-all", F.concat(F.lit("job"), "program")), F.lit("    steps:\n"), step(F.lit("v2")))
    return s.select("program", before.alias("before"), after.alias("after"), target.alias("target"))


def _edits(docs: DataFrame) -> DataFrame:
    sides = [document_nodes(docs, ["program"], text=c) for c in ("before", "after")]
    return patches.compile_edits(*sides, ["program"])


def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    texts = docs.select("program", F.col("target").alias("text"))
    pins = spark.createDataFrame([("acme/fetch", "v2", "2" * 40)], "action string, ref string, sha string")
    patched, _ = patches.apply_programs(_edits(docs), docs.select("program"), texts, document_nodes(texts, ["program"]), ["program"], ["program"], pins)
    return patched


def patch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    texts = docs.select("program", F.col("target").alias("text"))
    _, outcomes = patches.apply_programs(_edits(docs), docs.select("program"), texts, document_nodes(texts, ["program"]), ["program"], ["program"])
    return patches.run_summary(outcomes, ["program"])


def wsp_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    heads = docs.select("program", F.lit("acme/demo").alias("repository"), F.sha1("program").alias("commit_hash"), F.lit("ci.yml").alias("source_file"), F.array(F.lit("rule-a")).alias("target_idents"))
    programs, edits = patchtext.read(patchtext.render(heads, _edits(docs)))
    return programs.join(edits, "program").select("program", "repository", "commit_hash", F.array_join("target_idents", ",").alias("fixes"), "ordinal", "op", patchtext.anchor_text(F.col("anchor")).alias("anchor"), "key", "value", "pin_action")


def line_hunk_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.copy_paste(_documents(spark, sf_dir), ["program"])


def stream_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream to its end: the same rows as the batch query rule_status_crosstab."""
    from ..operators.reports import cross_tab

    events = table(spark, sf_dir, "events")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*").parquet(sf_dir)
    days = stream.select("event_id", "event_type", "value").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    days.awaitTermination()
    status = F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "middle").when(F.col("value") >= 50, "high")
    return cross_tab(spark.read.parquet(f"{folder}/out").withColumn("status", status), "event_type", "status", ["low", "middle", "high"])


Q.update({f.__name__: f for f in (patch_apply, patch_outcomes, wsp_roundtrip, line_hunk_replay, stream_available_now)})
_HEAD = "'# supplier ' || s_suppkey || chr(10) || 'permissions: {0}' || chr(10) || 'jobs:' || chr(10) || '  job' || s_suppkey || ':' || chr(10) || '    runs-on: n' || s_nationkey || chr(10) || '{1}    steps:' || chr(10)"
_STEP = "'      - uses: acme/fetch@{0}' || chr(10) || '      - name: build' || chr(10) || '        run: make s' || s_suppkey || chr(10)"
_TARGET = f"{_HEAD.format('write-all', '')} || {_STEP.format('v2')}"
_FIXED = f"{_HEAD.format('read-all', '    timeout-minutes: 10@').replace('10@', chr(39).join(['10', ' || chr(10) || ', '']))} || {_STEP.format('2' * 40 + ' # v2')}"
SQL["patch_apply"] = f"SELECT s_suppkey::VARCHAR AS program, {_FIXED} AS patched_text FROM supplier"
# Without the pins' hashes the pin is left to review; the permission and the time limit are put in.
SQL["patch_outcomes"] = """
SELECT s_suppkey::VARCHAR AS program, 3 AS n_edits, 2 AS n_applied, 0 AS n_created, 0 AS n_noop, 0 AS n_inapplicable, 1 AS n_needs_review, true AS changed, true AS needs_review, false AS fully_applied FROM supplier"""
SQL["wsp_roundtrip"] = """
SELECT s_suppkey::VARCHAR AS program, 'acme/demo' AS repository, sha1(s_suppkey::VARCHAR) AS commit_hash, 'ci.yml' AS fixes_file, 'rule-a' AS fixes, e.* FROM supplier, (VALUES
  (1, 'ensure_present', 'jobs.$JOB', 'timeout-minutes', '10', NULL), (2, 'rewrite_value', 'jobs.$JOB.steps[uses=acme/fetch]', 'uses', NULL, 'acme/fetch'),
  (3, 'rewrite_value', '.', 'permissions', '"read-all"', NULL)) e(ordinal, op, anchor, "key", "value", pin_action)""".replace(" 'ci.yml' AS fixes_file,", "")
# The changed block holds the job's old name, which no target has.
SQL["line_hunk_replay"] = f"SELECT s_suppkey::VARCHAR AS program, {_TARGET} AS patched_text, 'not_found' AS status FROM supplier"
SQL["stream_available_now"] = analytics.SQL["rule_status_crosstab"]
