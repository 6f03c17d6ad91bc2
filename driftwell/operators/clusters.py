"""Two-level clustering of fixes, and matching of new changes against the catalog of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import edit_line, set_key, template_digest, value_sketch
from .lineage import settle


def commit_templates(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, template_lines, template_hash) of changes (keys, path, change, old, new, old_kind, new_kind).

    Lines are a sorted bag over all files of a commit: equal lines count as often as they occur.
    """
    shape = value_sketch(F.coalesce("new_kind", "old_kind"), F.coalesce("new", "old"))
    lines = changes.select(*keys, edit_line(F.col("change"), F.col("path"), shape, value_sketch(F.col("old_kind"), F.col("old"))).alias("_line"))
    return hash_bags(lines, keys, F.col("_line"))


def hash_bags(rows: DataFrame, keys: list[str], line: Column) -> DataFrame:
    bags = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("template_lines"))
    return bags.withColumn("template_hash", template_digest(F.col("template_lines")))


def set_keys(rows: DataFrame, keys: list[str], item: Column, name: str = "fixes") -> DataFrame:
    return rows.groupBy(*keys).agg(set_key(F.collect_set(item)).alias(name))


def cluster(commits: DataFrame, set_name: str = "fixes", exemplars: int = 5, order: list[str] | None = None) -> DataFrame:
    """(fixes, template_hash, n_commits, exemplars): level-2 clusters, with the keys of their first commits.

    Counting is combined before rows move, and only each task's first commits of a cluster are ranked, so a cluster
    with a third of all commits is no task's burden.
    """
    order, by = order or ["repository", "commit_hash"], [set_name, "template_hash"]
    commits = settle(commits)
    firsts = first_of_each(commits, by, order, exemplars).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("exemplars"))
    return commits.groupBy(*by).agg(F.count("*").alias("n_commits")).join(firsts, by)


def level_one(commits: DataFrame, set_name: str = "fixes") -> DataFrame:
    """(fixes, n_commits, n_subclusters): two summing steps, so no set of templates is gathered."""
    pairs = commits.groupBy(set_name, "template_hash").agg(F.count("*").alias("_n"))
    return pairs.groupBy(set_name).agg(F.sum("_n").alias("n_commits"), F.count("*").alias("n_subclusters"))


def first_of_each(commits: DataFrame, by: list[str], order: list[str], k: int = 5) -> DataFrame:
    """The first k commits of each cluster, with their ``exemplar`` number."""
    return commits.withColumn("exemplar", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("exemplar") <= k)


def match_catalog(commits: DataFrame, catalog: DataFrame, set_name: str = "fixes") -> DataFrame:
    """commits with ``outcome``: ``full`` if set and template are known, ``level-1`` if the set is, else ``miss``.

    Spark broadcasts the catalog's keys where its statistics show them small.
    """
    sets = catalog.select(set_name).distinct().withColumn("_set", F.lit(True))
    templates = catalog.select(set_name, "template_hash").distinct().withColumn("_template", F.lit(True))
    found = commits.join(sets, set_name, "left").join(templates, [set_name, "template_hash"], "left")
    return found.withColumn("outcome", F.when(F.col("_template"), "full").when(F.col("_set"), "level-1").otherwise("miss")).drop("_set", "_template")
