"""Evaluation of patches: against findings, against human patches, and against other generators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import commit_folder, equality_step
from ..functions.dealing import spread
from ..functions.trees import equality_key, kind_of, parse, walk
from .gaps import GAP
from .reports import outcome_bucket

#: States of a comparison with a human patch before texts can be compared.
NO_SHA, NO_PARENT, NO_FILE, NO_PROGRAM = "missing_backport_sha", "no_parent_commit", "file_absent_at_parent_or_backport", "no_program"


def gap_pairs(audits: DataFrame, files: DataFrame) -> DataFrame:
    """(repository, commit_hash, branch, path) of files that a gap was found in: rows of the audit and its files."""
    open_branches = audits.filter((F.col("status") == "ok") & (F.col("verdict") == GAP)).select("repository", "commit_hash", "branch")
    return files.join(open_branches, ["repository", "commit_hash", "branch"]).filter(F.size("idents_present") > 0)


def true_backports(history: DataFrame) -> DataFrame:
    """Files whose branch got the fix later than the default branch did."""
    return history.filter("refined = 'true_backport' and backport_version is not null")


def backport_cases(history: DataFrame, commit_info: DataFrame, file_at_ref: DataFrame) -> DataFrame:
    """(repository, commit_hash, branch, path, backport_sha, parent_sha, parent_text, human_text) of true back-ports.

    The parent is the back-port's first; a text is missing where the forge has none.
    """
    rows = true_backports(history).select("repository", "commit_hash", "branch", "path", F.col("backport_version").alias("backport_sha"))
    parents = commit_info.select("repository", F.col("commit_sha").alias("backport_sha"), "parent_sha").dropDuplicates(["repository", "backport_sha"])
    there = file_at_ref.filter("content is not null").select("repository", F.col("ref"), "path", F.decode("content", "UTF-8").alias("_text"))
    text = lambda ref, name: there.select("repository", F.col("ref").alias(ref), "path", F.col("_text").alias(name))
    met = rows.join(parents, ["repository", "backport_sha"], "left")
    return met.join(text("parent_sha", "parent_text"), ["repository", "parent_sha", "path"], "left").join(text("backport_sha", "human_text"), ["repository", "backport_sha", "path"], "left")


def case_files(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, text) of the comparison's cases: the parent's, the human's and the patched text, and the outcome."""
    files = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("text")) for n, c in (("parent.yml", "parent_text"), ("human.yml", "human_text"), ("patched.yml", "patched_text"), ("outcome", "outcome"))])
    return rows.select(*keys, F.explode(F.filter(files, lambda f: f["text"].isNotNull())).alias("_f")).select(*keys, "_f.*")


def tree_text(rows: DataFrame, keys: list[str], text: str, name: str) -> DataFrame:
    """(keys, name): a canonical text of a document's tree: equal for equal trees, whatever the layout; null if unread."""
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)

    def canonical(body: str | None) -> str | None:
        tree = parse(body)
        if tree is None:
            return None
        lines = (f"{route} {kind_of(v)}" if isinstance(v, (dict, list)) else f"{route} = {equality_key(v)}" for _, _, route, v in walk(tree))
        return "\n".join(sorted(lines))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keys].assign(**{name: batch["_text"].map(canonical)})

    return spread(rows.select(*keys, F.col(text).alias("_text"))).mapInPandas(run, f"{schema}, `{name}` string")


def compare_with_human(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, backport_sha, parent_sha, parent_text, human_text, patched_text, effect) with ``outcome``.

    ``effect``: both patches leave the same findings. Texts that can't be parsed are compared as they are.
    """
    ours, theirs = (tree_text(rows, keys, c, f"_{c}") for c in ("patched_text", "human_text"))
    met = rows.join(ours, keys).join(theirs, keys)
    tree = F.coalesce(F.col("_patched_text") == F.col("_human_text"), F.lit(False))
    step = equality_step(F.col("patched_text") == F.col("human_text"), tree, F.coalesce("effect", F.lit(False)))
    outcome = (
        F.when(F.col("backport_sha").isNull(), NO_SHA).when(F.col("parent_sha").isNull(), NO_PARENT)
        .when(F.col("parent_text").isNull() | F.col("human_text").isNull(), NO_FILE).when(F.col("patched_text").isNull(), NO_PROGRAM).otherwise(step)
    )
    return met.withColumn("outcome", outcome).drop("_patched_text", "_human_text")


def same_effect(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, effect): findings (keys, ident, route) of two patches are the same set. Keys without findings are left out."""
    sides = ours.select(*keys, "ident", "route", F.lit(1).alias("o"), F.lit(0).alias("t")).unionAll(theirs.select(*keys, "ident", "route", F.lit(0), F.lit(1)))
    met = sides.groupBy(*keys, "ident", "route").agg(F.max("o").alias("o"), F.max("t").alias("t"))
    return met.groupBy(*keys).agg(F.bool_and(F.col("o") == F.col("t")).alias("effect"))


def verdict(runs: DataFrame, local: DataFrame, lint: DataFrame, keys: list[str]) -> DataFrame:
    """runs (keys, status, n_needs_review) with both oracles' answers, ``accepted`` and the capability bucket.

    lint: (keys, kind, message) that the patch introduced.
    """
    faults = lint.groupBy(*keys).agg(F.count("*").alias("n_lint"))
    met = runs.join(local, keys, "left").join(faults, keys, "left").fillna(0, ["n_lint", "n_scopes", "n_failed", "n_introduced"]).fillna(False, ["success"])
    ok, clean = F.col("success"), F.col("n_lint") == 0
    bucket = outcome_bucket(F.col("status"), ok, clean, F.col("n_scopes"), F.col("n_needs_review"), F.col("n_failed"), F.col("n_introduced"))
    return met.withColumns({"accepted": (F.col("status") == "patched") & ok & clean, "bucket": bucket})


def generator_outcome(rows: DataFrame) -> DataFrame:
    """rows (…, generator, output, oracle_status, oracle_ok, lint_ok) with ``outcome``; no output, or none at all, comes first."""
    outcome = (
        F.when(F.coalesce(F.trim("output"), F.lit("")) == "", "no_output").when(F.col("oracle_status") != "ok", "oracle_error")
        .when(F.col("oracle_ok") & F.col("lint_ok"), "accepted").when(~F.col("oracle_ok"), "failed_zizmor").when(~F.col("lint_ok"), "failed_actionlint").otherwise("other")
    )
    return rows.withColumn("outcome", outcome)


def other_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): changed paths that aren't an action's reference."""
    return changes.filter(~F.col("path").endswith(".uses")).groupBy(*keys).agg(F.count("*").alias("n"))


def compile_counters(edits: DataFrame) -> DataFrame:
    """One row: programs, edits, those to review, and programs that run without review."""
    by = edits.groupBy("program").agg(F.count("*").alias("n"), F.count("review").alias("r"))
    return by.agg(F.count("*").alias("n_programs"), F.sum("n").alias("n_edits"), F.sum("r").alias("n_review"), F.count_if(F.col("r") == 0).alias("n_automatable"))


def import_tag(earlier: DataFrame, classification: DataFrame, source: str) -> DataFrame:
    """Outcome rows made of another tag's audits: its kinds decide, unknown ones count as structural."""
    met = earlier.join(classification.select("repository", "commit_hash", "kind"), ["repository", "commit_hash"], "left")
    kind = F.coalesce("kind", F.lit("unknown"))
    outcome = F.when(kind.isin("mixed", "deletion"), "host_removed").when(F.col("status") == "ok", "audited").otherwise("audit_failed")
    return met.select("repository", "commit_hash", F.lit(None).cast("string").alias("processed_at"), F.lit(source).alias("source"), outcome.alias("outcome"), F.when(outcome == "audit_failed", F.col("status")).alias("reason"), F.lit(None).cast("string").alias("error"), commit_folder(F.col("repository"), F.col("commit_hash")).alias("dir"), kind.alias("host_classification"))
