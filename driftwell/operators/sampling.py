"""Deterministic samples of commits, the filter before them and the roll-up of their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import sample_hash


def valid_modifications(index: DataFrame) -> DataFrame:
    """Modified files, valid on both sides, with both versions: six columns."""
    kept = index.filter((F.col("git_change_type") == "M") & (F.col("valid_yaml") == "True") & (F.col("valid_workflow") == "True") & F.col("file_hash").isNotNull() & F.col("previous_file_hash").isNotNull())
    return kept.select("repository", "commit_hash", "committed_date", "file_path", "file_hash", "previous_file_hash")


def commits_to_do(index: DataFrame, done: DataFrame) -> DataFrame:
    """The index's commits that a log doesn't have, with their files: one read of the index, filtered before it moves."""
    fresh = valid_modifications(index).join(done.select("repository", "commit_hash").distinct(), ["repository", "commit_hash"], "left_anti")
    return roll_up(fresh, ["repository", "commit_hash"], "committed_date", [F.col(c) for c in ("file_path", "file_hash", "previous_file_hash")])


def roll_up(rows: DataFrame, keys: list[str], first: str, items: list[Column], name: str = "files") -> DataFrame:
    """One row a key: the smallest ``first`` and the sorted list of ``items`` as structs."""
    return rows.groupBy(*keys).agg(F.min(first).alias(first), F.sort_array(F.collect_list(F.struct(*items))).alias(name))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 42, tie: list[str] | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """The n rows whose keys have the smallest hashes, so a larger sample holds a smaller one of the same seed.

    ``exclude``: rows whose key another sample has are left out first. The limit becomes a top-k of each task.
    """
    if exclude is not None:
        rows = rows.join(exclude.select(key).distinct(), key, "left_anti")
    return rows.withColumn("sample_hash", sample_hash(F.col(key), seed)).orderBy("sample_hash", *(tie or []), key).limit(n)


def sample_commits(index: DataFrame, n: int = 10_000, seed: int = 42, exclude: DataFrame | None = None) -> DataFrame:
    files = [F.col(c) for c in ("file_path", "file_hash", "previous_file_hash")]
    commits = roll_up(valid_modifications(index), ["repository", "commit_hash"], "committed_date", files)
    return hash_sample(commits, "commit_hash", n, seed, ["repository"], exclude).drop("sample_hash")


def file_diffs(sampled: DataFrame) -> DataFrame:
    """Sampled commits as a row for each file."""
    return sampled.select("repository", "commit_hash", "committed_date", F.explode("files").alias("f")).select("repository", "commit_hash", "committed_date", "f.*")


def distinct_blobs(files: DataFrame) -> DataFrame:
    """Every version's hash once."""
    return files.select(F.col("file_hash")).unionAll(files.select("previous_file_hash")).filter("file_hash is not null").distinct()
