"""The gap audit: on which maintenance branches is a fixed finding still there?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import is_release_branch

#: Verdicts of a branch.
GAP, FIXED, INAPPLICABLE = "gap", "already_fixed", "inapplicable"


def release_branches(branches: DataFrame, repos: DataFrame) -> DataFrame:
    return branches.join(repos, "repository").filter(is_release_branch(F.col("branch"), F.col("default_branch")))


def branch_verdict(files: DataFrame, keys: list[str], status: str = "file_status", present: str = "idents_present") -> DataFrame:
    """Verdict of each branch from its files (status absent, scan_failed or ok; target idents still present).

    A file that is there but wasn't scanned counts as there; ``n_scan_failed`` tells how many such files there are.
    """
    has = F.col(status) != "absent"
    left = F.coalesce(F.size(F.col(present)), F.lit(0)) > 0
    # One row an ident (a file without any has one of none), so that sets are combined before rows move; a file counts by its first.
    idents = F.when(F.col(status) == "ok", F.col(present))
    rows = files.select(*keys, status, left.alias("_left"), has.alias("_has"), F.posexplode_outer(idents).alias("_at", "_ident"))
    by_branch = rows.groupBy(*keys).agg(
        F.bool_or((F.col(status) == "ok") & F.col("_left")).alias("_gap"),
        F.bool_or("_has").alias("_there"),
        F.count_if((F.col(status) == "scan_failed") & (F.coalesce("_at", F.lit(0)) == 0)).alias("n_scan_failed"),
        F.array_sort(F.collect_set("_ident")).alias("idents_present"),
    )
    return by_branch.withColumn("verdict", F.when(F.col("_gap"), GAP).when(F.col("_there"), FIXED).otherwise(INAPPLICABLE)).drop("_gap", "_there")


def audit(clean: DataFrame, repos: DataFrame, branches: DataFrame, on_branch: DataFrame, file_at_ref: DataFrame, scans: DataFrame) -> DataFrame:
    """Audit every clean fix: one row a (commit, release branch), or one with a status for commits that have none.

    The statuses come in this order: repo_error (unknown repository), not_on_default, branches_error, ok.
    """
    commits = clean.select("repository", "commit_hash", "V_fixed_idents", F.filter("files", lambda f: F.size(f["V_fixed"]) > 0).alias("target_files"))
    commits = commits.join(repos, "repository", "left")
    reached = on_branch.filter("reachable").select("repository", F.col("branch").alias("default_branch"), "commit_hash", F.lit(True).alias("_reached"))
    commits = commits.join(reached, ["repository", "default_branch", "commit_hash"], "left")
    listed = branches.select("repository").distinct().withColumn("_listed", F.lit(True))
    commits = commits.join(listed, "repository", "left")
    status = F.when(F.col("default_branch").isNull(), "repo_error").when(F.col("_reached").isNull(), "not_on_default").when(F.col("_listed").isNull(), "branches_error").otherwise("ok")
    commits = commits.withColumns({"status": status, "_paths": F.transform("target_files", lambda f: f["file_path"])}).drop("_reached", "_listed", "target_files")

    # A verdict depends on the files and idents that are looked for; commits that look for the same share it.
    looked = ["repository", "_paths", "V_fixed_idents"]
    release = release_branches(branches, repos).select("repository", "branch")
    files = commits.filter("status = 'ok'").select(*looked).distinct().join(release, "repository").select(*looked, "branch", F.explode_outer("_paths").alias("path"))
    there = file_at_ref.select("repository", F.col("ref").alias("branch"), "path", "blob_sha", "missing")
    idents = scans.select(F.col("file_hash").alias("blob_sha"), "ok", F.array_distinct(F.transform("findings", lambda f: f["ident"])).alias("_idents"))
    met = files.join(there, ["repository", "branch", "path"], "left").join(idents, "blob_sha", "left")
    absent = F.coalesce("missing", F.lit(True))
    met = met.withColumns({
        "file_status": F.when(absent, "absent").when(F.coalesce("ok", F.lit(False)), "ok").otherwise("scan_failed"),
        "idents_present": F.when(F.col("ok"), F.array_intersect("_idents", "V_fixed_idents")),
    })
    verdicts = branch_verdict(met, [*looked, "branch"]).withColumnsRenamed({c: f"_of_{c}" for c in looked})
    same = (F.when(F.col("status") == "ok", F.col("repository")) == F.col("_of_repository")) & F.col("_paths").eqNullSafe(F.col("_of__paths")) & F.col("V_fixed_idents").eqNullSafe(F.col("_of_V_fixed_idents"))
    return commits.join(verdicts, same, "left").select("repository", "commit_hash", "default_branch", "status", "V_fixed_idents", "branch", "n_scan_failed", "idents_present", "verdict")


def headline(verdicts: DataFrame, by: list[str] | None = None, verdict: str = "verdict") -> DataFrame:
    """Counts of branches by verdict and the two gap rates (of all, and of those that could have a gap)."""
    n = lambda v: F.count_if(F.col(verdict) == v)
    sums = verdicts.groupBy(*(by or [])).agg(F.count(verdict).alias("n_branches"), n(GAP).alias("n_gap"), n(FIXED).alias("n_fixed"), n(INAPPLICABLE).alias("n_inapplicable"))
    share = lambda total: F.round(F.col("n_gap") / F.nullif(total, F.lit(0)), 6)
    return sums.withColumns({"gap_rate": share(F.col("n_branches")), "actionable_rate": share(F.col("n_gap") + F.col("n_fixed"))})


def refilter_headline(audits: DataFrame, classification: DataFrame) -> DataFrame:
    """The headline before and after keeping structural fixes alone: two rows, ``scope`` all and structural.

    Commits and repositories are counted by grouping twice, so no set of them is gathered.
    """
    ok = audits.filter("status = 'ok'")

    def one(rows: DataFrame, scope: str) -> DataFrame:
        gap = F.coalesce(F.bool_or(F.col("verdict") == GAP), F.lit(False))
        commits = rows.groupBy("repository", "commit_hash").agg(gap.alias("_g"), F.count("verdict").alias("n_branches"), *[F.count_if(F.col("verdict") == v).alias(n) for v, n in ((GAP, "n_gap"), (FIXED, "n_fixed"), (INAPPLICABLE, "n_inapplicable"))])
        repos = commits.groupBy("repository").agg(F.bool_or("_g").alias("_g"), F.count("*").alias("n_commits"), F.count_if("_g").alias("n_commits_with_gap"), *[F.sum(c).alias(c) for c in ("n_branches", "n_gap", "n_fixed", "n_inapplicable")])
        sums = ("n_commits", "n_commits_with_gap", "n_branches", "n_gap", "n_fixed", "n_inapplicable")
        out = repos.agg(F.count("*").alias("n_repos"), F.count_if("_g").alias("n_repos_with_gap"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
        share = lambda total: F.round(F.col("n_gap") / F.nullif(total, F.lit(0)), 6)
        return out.select(F.lit(scope).alias("scope"), *out.columns, share(F.col("n_branches")).alias("gap_rate"), share(F.col("n_gap") + F.col("n_fixed")).alias("actionable_rate"))

    return one(ok, "all").unionAll(one(structural_only(ok, classification), "structural"))


def audit_summary(audits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(commits by status; one row of totals; commits by number of gap branches; surviving idents by branches)."""
    by_commit = audits.groupBy("repository", "commit_hash", "status").agg(F.count("verdict").alias("n_branches"), F.count_if(F.col("verdict") == GAP).alias("n_gap"), F.count_if(F.col("verdict") == FIXED).alias("n_fixed"), F.count_if(F.col("verdict") == INAPPLICABLE).alias("n_inapplicable"))
    ok = by_commit.filter("status = 'ok'")
    totals = ok.agg(F.count("*").alias("n_ok"), F.count_if(F.col("n_gap") > 0).alias("n_with_gap"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_branches", "n_gap", "n_fixed", "n_inapplicable")])
    idents = audits.filter((F.col("status") == "ok") & (F.col("verdict") == GAP)).select(F.explode("idents_present").alias("ident")).groupBy("ident").agg(F.count("*").alias("n"))
    return by_commit.groupBy("status").agg(F.count("*").alias("n")), totals, ok.groupBy("n_gap").agg(F.count("*").alias("n")), idents


def kind_counts(classification: DataFrame) -> DataFrame:
    """Commits by kind of fix, with their share."""
    from .reports import shares

    return shares(classification.select("repository", "commit_hash", "kind").distinct(), "kind")


def structural_only(rows: DataFrame, classification: DataFrame) -> DataFrame:
    """Rows of commits whose fix was structural."""
    return rows.join(classification.filter("kind = 'structural'").select("repository", "commit_hash").distinct(), ["repository", "commit_hash"], "left_semi")


def not_done(rows: DataFrame, done: DataFrame, keys: list[str], status: str | None = None, retry: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose keys a log doesn't have; logged rows with a ``retry`` status count as not done."""
    if status and retry:
        done = done.filter(~F.coalesce(F.col(status).isin(*retry), F.lit(False)))
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def still_open(pairs: DataFrame, idents: Column) -> DataFrame:
    """(commit, branch, file) rows where a target ident survives."""
    return pairs.filter((F.col("verdict") == GAP) & (F.size(idents) > 0))
