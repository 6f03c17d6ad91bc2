"""Edits without loss, on documents of suppliers with ports, modes, dates, anchors, merge keys and dotted keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.syntax import document_tokens
from ..functions.trees import document_nodes
from ..functions.columns import commit_folder
from ..operators import patches
from ..operators.lineage import shared_folder, unsized
from ..sources import filetree
from ..sources.tables import read_meta
from .tables import table

#: SQL of a text that both engines read; the braces take what a program changes.
_TEXT = r"""('# ' || s_name || '
x-base: &base   # shared
  retries: ' || CAST(s_nationkey AS STRING) || '
  mode: 0755
services:
  "db.' || CAST(s_suppkey AS STRING) || '":
    ports: [ 22:' || CAST(s_suppkey % 60 AS STRING) || ', "80:80" ]   # both
    since: {since}   # last seen
    total: 1_000
    <<: *base
env.x: {env}
env: {{x: {{a: 9}}}}   # another
copy: *base
on: push
')"""
BEFORE = _TEXT.format(since="2024-01-31", env="{a: 1,  b: \"' || s_name || '\"}")
#: The program names its own keys alone: the drifted target has more.
PROGRAM = """('services:
  db.' || CAST(s_suppkey AS STRING) || ':
    since: {since}
env.x: {env}
')"""

SIDES = {"before": PROGRAM.format(since="2024-01-31", env="{a: 1, b: \"' || s_name || '\"}"), "after": PROGRAM.format(since="2025-02-28", env="{a: 07}")}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS program", f"{BEFORE} AS text", *[f"{text} AS {side}" for side, text in SIDES.items()])


def lossless_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date rewritten, and in a mapping whose key has a dot one entry changed and one removed; all else as it was."""
    docs = _documents(spark, sf_dir)
    edits = patches.compile_edits(*[document_nodes(docs, ["program"], text=c) for c in ("before", "after")], ["program"])
    texts = docs.select("program", "text")
    patched, outcomes = patches.apply_programs(edits, docs.select("program"), texts, document_nodes(texts, ["program"]), ["program"], ["program"])
    counts = patches.run_summary(outcomes, ["program"]).select("program", "n_edits", "n_applied")
    return patched.join(counts, "program")


def document_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put together again from the tokens of their syntax trees and what lies between; tokens by kind."""
    docs = unsized(_documents(spark, sf_dir).select("program", "text"))
    tokens = document_tokens(docs, ["program"])
    leaf = F.col("kind").isin("scalar", "alias")
    token = F.struct("start", "end", (F.col("role") == "key").alias("key"))
    found = tokens.groupBy("program").agg(
        F.sort_array(F.collect_list(F.when(leaf, token))).alias("leaves"), F.count_if(F.col("kind") == "alias").alias("n_aliases"), F.count("anchor").alias("n_anchors"),
        F.count_if(F.col("role") == "key").alias("n_keys"), F.max(F.when(F.col("value") == "0755", F.array_join("path", "/"))).alias("mode_at"), F.max("line").alias("last_line"),
    )
    rows = docs.join(found, "program")
    # before each leaf what lies between it and the one before
    part = lambda start, end: F.substring("text", (start + 1).cast("int"), (end - start).cast("int"))
    before = lambda i: F.coalesce(F.get("leaves", i - 1)["end"], F.lit(0))
    pieces = F.transform("leaves", lambda x, i: F.concat(part(before(i), x["start"]), part(x["start"], x["end"])))
    rest = part(F.try_element_at("leaves", F.lit(-1))["end"], F.length("text"))
    return rows.select("program", F.concat(F.array_join(pieces, ""), rest).alias("rebuilt"), "n_aliases", "n_anchors", "n_keys", "mode_at", "last_line")


def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each supplier with both versions and its meta, written by tasks and read back."""
    docs = _documents(spark, sf_dir).withColumn("commit_hash", F.sha1("program"))
    fixed = F.array(F.struct(F.lit("since").alias("ident"), F.concat(F.lit("services.db."), "program").alias("route")))
    none = F.array().cast(fixed_type := "array<struct<ident:string,route:string>>")
    files = F.array(F.struct(F.lit("f.yml").alias("file_path"), F.lit("before.yml").alias("before"), F.lit("after.yml").alias("after"), F.lit("ok").alias("scan_status"), fixed.cast(fixed_type).alias("V_fixed"), none.alias("V_introduced")))
    meta = docs.select(F.concat(F.lit("acme/s"), "program").alias("repository"), "commit_hash", F.lit(None).cast("string").alias("github_url"), F.lit(1).alias("V_fixed_count"), F.array(F.lit("since")).alias("V_fixed_idents"), F.lit(1).alias("n_files_modified"), files.alias("files"))
    name = commit_folder(F.concat(F.lit("acme/s"), F.col("program")), F.col("commit_hash")).alias("dir")
    sides = docs.select(name, F.explode(F.array(*[F.struct(F.lit(f"{c}.yml").alias("name"), F.col(c).alias("text")) for c in ("before", "after")])).alias("f")).select("dir", "f.name", "f.text")
    folder = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    filetree.write_tree(sides.unionAll(filetree.meta_files(meta)), folder)
    read = filetree.read_tree(spark, folder).filter("name != 'meta.json'")
    told = read_meta(spark, f"{folder}/*/meta.json").select("dir", "repository", F.col("files")[0]["V_fixed"][0]["route"].alias("route"))
    return read.join(told, "dir").select("repository", "route", "name", F.md5("text").alias("digest"))


Q = {f.__name__: f for f in (lossless_edits, document_syntax, file_tree)}
SQL = {
    "lossless_edits": f"SELECT s_suppkey::VARCHAR AS program, {_TEXT.format(since=chr(39) * 2 + '2025-02-28' + chr(39) * 2, env='{a: 7}')} AS patched_text, 3 AS n_edits, 3 AS n_applied FROM supplier",
    "document_syntax": f"SELECT s_suppkey::VARCHAR AS program, {BEFORE} AS rebuilt, 2 AS n_aliases, 1 AS n_anchors, 17 AS n_keys, 'x-base/mode' AS mode_at, 13 AS last_line FROM supplier",
    "file_tree": " UNION ALL ".join(f"SELECT 'acme/s' || s_suppkey AS repository, 'services.db.' || s_suppkey AS route, '{side}.yml' AS name, md5({text}) AS digest FROM supplier" for side, text in SIDES.items()),
}
