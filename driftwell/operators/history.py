"""When was a fix back-ported? The boundary in a branch's history, its lag and its statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import days_between, lag_bucket, refined_status
from ..schemas import SCHEMAS
from .lineage import settle

CAP = 50
#: Statuses of a history walk, and reasons of those that tell nothing.
CONFIRMED, NEVER, INCONCLUSIVE = "confirmed_backport", "never_had_it", "inconclusive"
AT_HEAD, CAPPED, UNREADABLE = "fix_present_at_head_contradicts_already_fixed", "history_cap_reached", "no_scannable_history"


def history_boundary(versions: DataFrame, entity: list[str], order: list[Column], version: str, committed: str, scannable: str, present: str, cap: int = CAP) -> DataFrame:
    """One row an entity: where the target was last seen, walking from the newest version.

    ``order`` sorts newest first. Versions that can't be read are passed over; at most ``cap`` are read. The version
    after (newer than) the newest with the target is the back-port. Windows are by entity and end at the cap:
    older versions are cut off before anything is ranked against them.
    """
    walk = Window.partitionBy(*entity).orderBy(*order)
    before = F.coalesce(F.sum(F.col(scannable).cast("int")).over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = versions.withColumn("_read", before).filter(F.col("_read") <= cap)
    # The first version listed after the cap shows only that there is more history.
    read = listed.withColumn("_in", F.col(scannable) & (F.col("_read") < cap))
    newer = F.lag(F.struct(F.col(version).alias("v"), F.col(committed).alias("at"))).over(Window.partitionBy(*entity, "_in").orderBy(*order))
    seen = read.withColumn("_newer", newer).withColumn("_hit", F.col("_in") & F.col(present))
    first = F.min_by(F.struct(F.col("_newer"), F.lit(True).alias("hit")), F.when(F.col("_hit"), F.col("_read")))
    ends = seen.groupBy(*entity).agg(first.alias("_first"), F.count_if("_in").alias("n_read"), F.count_if(F.col("_read") >= cap).alias("_more"))
    hit = F.coalesce("_first.hit", F.lit(False))
    status = F.when(hit & F.col("_first._newer").isNotNull(), CONFIRMED).when(hit, INCONCLUSIVE).when(F.col("n_read") == 0, INCONCLUSIVE).when(F.col("_more") > 0, INCONCLUSIVE).otherwise(NEVER)
    reason = F.when(hit & F.col("_first._newer").isNull(), AT_HEAD).when(hit, F.lit(None).cast("string")).when(F.col("n_read") == 0, UNREADABLE).when(F.col("_more") > 0, CAPPED)
    return ends.select(*entity, status.alias("status"), reason.alias("reason"), F.col("_first._newer.v").alias("backport_version"), F.col("_first._newer.at").alias("backported_at"), "n_read")


def walk_in_rounds(asked: DataFrame, listed: DataFrame, entity: list[str], fetch: Callable[[DataFrame], DataFrame], scan: Callable[[DataFrame], DataFrame], step: int = 4, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(versions walked, scans made): histories read from their newest version on, only as far as they must be.

    asked: (entity, V_fixed_idents), listed: (entity, commit_sha, path, repository, place), place 1 the newest version.
    A round takes the next ``step`` versions of each entity that is still open, fetches those files that no round has
    fetched (``fetch``: repository, commit_sha, path to the same with blob_sha, content, missing), scans those blobs
    that none has scanned (``scan``: file_hash, content to scans), and closes what has an answer: an entity with a
    version that still has one of the idents, with ``cap`` versions read, or at its history's end. So an entity reads
    ``step`` - 1 versions more than it needs at most, and a round's work is that of the open ones. What a round did is
    written to the checkpoint folder, and the next starts from there.
    """
    spark = asked.sparkSession
    keys = ["repository", "commit_sha", "path"]
    walked = spark.createDataFrame([], f"{', '.join(f'`{c}` {asked.schema[c].dataType.simpleString()}' for c in entity)}, place int, _ok boolean, _hit boolean")
    fetched = spark.createDataFrame([], "repository string, commit_sha string, path string, file_hash string")
    scans = spark.createDataFrame([], SCHEMAS["scans"])
    length = listed.groupBy(*entity).agg(F.max("place").alias("_length"))
    frontier = settle(asked.join(length, entity).withColumns({"_done": F.lit(0), "_read": F.lit(0).cast("long")}))
    while frontier.limit(1).count():
        reach = F.col("_done") + F.least(F.lit(step), F.lit(cap) - F.col("_read"))
        due = settle(listed.join(frontier, entity).filter((F.col("place") > F.col("_done")) & (F.col("place") <= reach)).select(*entity, *[k for k in keys if k not in entity], "place", "V_fixed_idents"))
        files = settle(due.select(*keys).distinct().join(fetched.select(*keys), keys, "left_anti"))
        new = settle(fetch(files).filter(~F.coalesce("missing", F.lit(False))).select(*keys, F.col("blob_sha").alias("file_hash"), "content"))
        fetched = settle(fetched.unionByName(files.join(new.select(*keys, "file_hash"), keys, "left")))
        blobs = new.select("file_hash", "content").dropDuplicates(["file_hash"]).join(scans.select("file_hash"), "file_hash", "left_anti")
        scans = settle(scans.unionByName(scan(blobs).select(*scans.columns)))
        idents = scans.filter("ok").select("file_hash", F.transform("findings", lambda f: f["ident"]).alias("_idents"))
        seen = due.join(fetched, keys, "left").join(idents, "file_hash", "left")
        seen = settle(seen.select(*entity, "place", F.col("_idents").isNotNull().alias("_ok"), F.coalesce(F.arrays_overlap("_idents", "V_fixed_idents"), F.lit(False)).alias("_hit")))
        walked = settle(walked.unionByName(seen))
        told = seen.groupBy(*entity).agg(F.max("place").alias("_at"), F.count_if("_ok").alias("_n"), F.bool_or("_hit").alias("_any"))
        met = frontier.join(told, entity).withColumns({"_done": F.col("_at"), "_read": F.col("_read") + F.col("_n")})
        frontier = settle(met.filter(~F.col("_any") & (F.col("_read") < cap) & (F.col("_done") < F.col("_length"))).select(*frontier.columns))
    return walked, scans


def with_lag(boundaries: DataFrame, masters: DataFrame, keys: list[str], fixed_at: str) -> DataFrame:
    """boundaries with ``lag_days`` after the fix on the default branch, and the refined status."""
    dated = boundaries.join(masters.select(*keys, fixed_at), keys, "left")
    lag = F.when(F.col("status") == CONFIRMED, days_between(F.col(fixed_at), F.col("backported_at")))
    return dated.withColumn("lag_days", lag).withColumn("refined", refined_status(F.col("status"), F.col("lag_days")))


def branch_roll_up(files: DataFrame, keys: list[str]) -> DataFrame:
    """Branches from files: a confirmed file wins, with the longest lag; then one that never had it."""
    return files.groupBy(*keys).agg(
        F.when(F.bool_or(F.col("status") == CONFIRMED), CONFIRMED).when(F.bool_or(F.col("status") == NEVER), NEVER).otherwise(INCONCLUSIVE).alias("status"),
        F.max(F.when(F.col("status") == CONFIRMED, F.col("lag_days"))).alias("lag_days"),
        F.count("*").alias("n_files"),
    )


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None, bins: int = 32, accuracy: int = 2560) -> DataFrame:
    """(by, name, value): the value at place min(int(share * n), n - 1) of the ascending list, counted from 0.

    Equal values are counted first. Ranges are cut at the group's own approximate quantiles, some evenly and two close
    by each share, so far values don't put all others into one, and a share's range is narrow; the counts of ranges tell
    which holds a place, and only that range's values are ranked. The answer is exact, whatever the quantiles are.
    """
    by = by or []
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    group = [F.lit(0).alias("_all_rows"), *[F.col(c) for c in by]]
    keys = ["_all_rows", *by]
    counts = counts.select(*group, F.col(value).cast("double").alias("_v"), "_n")
    at = {i / bins for i in range(1, bins)} | {min(max(s + d, 0.0), 1.0) for s in shares.values() for d in (-4 / accuracy, 4 / accuracy)}
    cuts = F.array_sort(F.array_distinct(F.percentile_approx("_v", sorted(at), accuracy)))
    ends = counts.groupBy(*keys).agg(cuts.alias("_cuts"), F.sum("_n").alias("_total"))
    met = counts.join(ends, keys).withColumn("_bin", F.size(F.filter("_cuts", lambda c: c <= F.col("_v"))))
    placed = met.drop("_cuts")
    sums = placed.groupBy(*keys, "_total", "_bin").agg(F.sum("_n").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(s)).alias("share")) for n, s in shares.items()]))
    asked = sums.withColumn("_before", upto - F.col("_n")).withColumn("_p", named).withColumn("_at", F.least(F.floor(F.col("_p.share") * F.col("_total")), F.col("_total") - 1))
    held = asked.filter((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_n"))).select(*keys, "_bin", "_before", "_at", F.col("_p.name").alias("name"))
    near = placed.select(*keys, "_bin", "_v", F.col("_n").alias("_c")).join(held, [*keys, "_bin"])
    within = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = near.withColumn("_upto", within).filter((F.col("_upto") - F.col("_c") <= F.col("_at")) & (F.col("_at") < F.col("_upto")))
    return ranked.select(*by, "name", F.col("_v").alias("value"))


def lag_summary(rows: DataFrame, lag: str = "lag_days") -> DataFrame:
    known = rows.filter(F.col(lag).isNotNull())
    return known.agg(F.count("*").alias("n"), F.min(lag).alias("min"), F.max(lag).alias("max"), F.round(F.avg(lag), 6).alias("mean"))


def lag_histogram(rows: DataFrame, lag: str = "lag_days") -> DataFrame:
    return rows.withColumn("bucket", lag_bucket(F.col(lag))).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def inconclusive_reasons(files: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, reason, n): the dominant reason of inconclusive branches; errors count as ``scan_error``."""
    told = files.filter(F.col("status").isin(INCONCLUSIVE, "error")).withColumn("reason", F.when(F.col("status") == "error", "scan_error").otherwise(F.col("reason")))
    return dominant_reason(told, keys, "reason", order)


def history_summary(branches: DataFrame, refined: str = "refined", idents: str = "V_fixed_idents") -> tuple[DataFrame, DataFrame]:
    """(branches by refined status with their share; (ident, status, n) of branches that got the fix)."""
    from .reports import shares

    by_ident = branches.filter(F.col(refined).isin("true_backport", "same_day_fix", "independent_prior_fix")).select(F.explode(idents).alias("ident"), refined)
    return shares(branches, refined), by_ident.groupBy("ident", refined).agg(F.count("*").alias("n"))


def true_backports(branches: DataFrame, keys: list[str]) -> DataFrame:
    """Branches with a true back-port, by lag; an unknown lag counts as none."""
    return branches.filter("refined = 'true_backport'").orderBy(F.coalesce("lag_days", F.lit(0.0)), *keys)


def lag_cluster(branches: DataFrame, repo: str = "repository", low: float = 30, high: float = 90) -> DataFrame:
    """(repo, n): true back-ports with a lag over ``low`` and up to ``high`` days."""
    within = branches.filter((F.col("refined") == "true_backport") & (F.col("lag_days") > low) & (F.col("lag_days") <= high))
    return within.groupBy(repo).agg(F.count("*").alias("n"))


def dominant_reason(rows: DataFrame, keys: list[str], reason: str, order: str) -> DataFrame:
    """The most frequent reason of each key; of equally frequent ones that seen first by ``order``."""
    counts = rows.withColumn(reason, F.coalesce(reason, F.lit("unknown"))).groupBy(*keys, reason).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "_first", reason)))
    return ranked.filter("_r = 1").drop("_r", "_first")
