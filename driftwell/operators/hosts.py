"""Did the construct that hosted a finding survive the fix?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import host_of_route

#: Kinds of a fix.
STRUCTURAL, MIXED, DELETION = "structural", "mixed", "deletion"


def surviving_jobs(before_steps: DataFrame, after_steps: DataFrame, before_jobs: DataFrame, after_jobs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, job, after_job): a job survives under its name, or as the first after-job that shares a step identity.

    jobs: (keys, job, position); steps: (keys, job, step, identity). Anonymous steps identify nothing.
    """
    same = before_jobs.select(*keys, "job").join(after_jobs.select(*keys, "job"), [*keys, "job"], "left_semi").withColumn("after_job", F.col("job"))
    lost = before_jobs.select(*keys, "job").join(after_jobs.select(*keys, "job"), [*keys, "job"], "left_anti")
    named = lambda s: s.filter("identity <> 'anon'").select(*keys, "job", "identity").distinct()
    shared = lost.join(named(before_steps), [*keys, "job"]).join(named(after_steps).withColumnRenamed("job", "after_job"), [*keys, "identity"])
    at = after_jobs.select(*keys, F.col("job").alias("after_job"), "position")
    renamed = shared.select(*keys, "job", "after_job").distinct().join(at, [*keys, "after_job"]).groupBy(*keys, "job").agg(F.min_by("after_job", "position").alias("after_job"))
    return same.unionByName(renamed)


def host_survival(findings: DataFrame, before_steps: DataFrame, after_steps: DataFrame, before_jobs: DataFrame, after_jobs: DataFrame, after_services: DataFrame, keys: list[str]) -> DataFrame:
    """findings (keys, ident, route) with host_kind and ``survived``."""
    hosts = findings.withColumn("_h", host_of_route(F.coalesce("route", F.lit("")))).select(*findings.columns, F.col("_h.kind").alias("host_kind"), F.col("_h.job").alias("job"), F.col("_h.service").alias("service"), F.col("_h.step").alias("step"))
    jobs = surviving_jobs(before_steps, after_steps, before_jobs, after_jobs, keys)
    anchored = hosts.join(before_steps.select(*keys, "job", "step", F.col("identity").alias("_identity")), [*keys, "job", "step"], "left").join(jobs, [*keys, "job"], "left")
    steps = after_steps.select(*keys, F.col("identity").alias("_identity"), F.lit(True).alias("_step")).distinct()
    services = after_services.select(*keys, F.col("job").alias("after_job"), "service", F.lit(True).alias("_service")).distinct()
    met = anchored.join(steps, [*keys, "_identity"], "left").join(services, [*keys, "after_job", "service"], "left")
    job = F.col("after_job").isNotNull()
    step = F.when(F.col("_identity").isNull(), F.lit(False)).when(F.col("_identity") == "anon", job).otherwise(F.coalesce("_step", F.lit(False)))
    survived = F.when(F.col("host_kind") == "step", step).when(F.col("host_kind") == "service", F.coalesce("_service", F.lit(False))).when(F.col("host_kind") == "job", job).otherwise(F.lit(True))
    return met.select(*findings.columns, "host_kind", survived.alias("survived"))


def file_kind(findings: DataFrame, keys: list[str], survived: str = "survived") -> DataFrame:
    """(keys, kind, n_findings, n_survived): structural if all hosts survive, deletion if none does."""
    counts = findings.groupBy(*keys).agg(F.count("*").alias("n_findings"), F.count_if(survived).alias("n_survived"))
    return counts.withColumn("kind", F.when(F.col("n_survived") == F.col("n_findings"), STRUCTURAL).when(F.col("n_survived") == 0, DELETION).otherwise(MIXED))


def commit_kind(files: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """(keys, kind): structural if all files are, deletion if none is structural or mixed, else mixed."""
    n = lambda k: F.count_if(F.col(kind) == k)
    return files.groupBy(*keys).agg(F.when(n(STRUCTURAL) == F.count("*"), STRUCTURAL).when(n(STRUCTURAL) + n(MIXED) == 0, DELETION).otherwise(MIXED).alias("kind"))
