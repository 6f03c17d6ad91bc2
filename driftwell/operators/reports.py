"""Reports: roll-ups of audits, histories, catalogs and oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Buckets of the capability report.
BUCKETS = ("accepted", "needs_review_only", "no_landed_edits", "failed_actionlint", "failed_zizmor_local", "regression_in_scope", "fetch_or_compile_error", "other")
#: Audit results of the capability report, of the comparison with human patches and of generators.
REPRODUCED = ("byte_equal", "ast_equal", "effect_equal")


def shares(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, share of all): the total is one row, joined to a few."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))  # total is one row


def histogram(rows: DataFrame, keys: list[str], name: str = "size") -> DataFrame:
    """How many keys have how many rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def top(rows: DataFrame, keys: list[str], k: int = 15, measure: Column | None = None, name: str = "n") -> DataFrame:
    """The k keys with the greatest measure (rows, if none is given); ties by the keys."""
    return rows.groupBy(*keys).agg((measure if measure is not None else F.count("*")).alias(name)).orderBy(F.col(name).desc(), *keys).limit(k)


def catalog_distribution(clusters: DataFrame, members: str = "fixes") -> DataFrame:
    """By size of the fixed set: patterns, commits, sub-clusters and their ratio to commits."""
    sized = clusters.withColumn("set_size", F.size(F.split(members, ",")))
    return sized.groupBy("set_size").agg(F.count("*").alias("n_patterns"), F.sum("n_commits").alias("n_commits"), F.sum("n_subclusters").alias("n_subclusters")).withColumn(
        "uniqueness", F.round(F.col("n_subclusters") / F.col("n_commits"), 6)
    )


def repo_coverage(branches: DataFrame, repo: str, gap: Column, fixed: Column) -> DataFrame:
    """One row: repositories in all, with a gap, with a fix, with both, either and neither."""
    by_repo = branches.groupBy(repo).agg(F.bool_or(gap).alias("g"), F.bool_or(fixed).alias("f"))
    n = lambda c: F.count_if(c)
    g, f = F.coalesce("g", F.lit(False)), F.coalesce("f", F.lit(False))
    return by_repo.agg(F.count("*").alias("n_all"), n(g).alias("n_gap"), n(f).alias("n_fixed"), n(g & f).alias("n_both"), n(g | f).alias("n_either"), n(~g & ~f).alias("n_neither"))


def density(rows: DataFrame, repo: str, item: str, measure: str) -> DataFrame:
    """Per repository: sum, average, maximum, and the first item that has it."""
    greatest = F.max(F.struct(F.col(measure).alias("_value"), (-F.col(item)).alias("_item")))
    sums = rows.groupBy(repo).agg(F.sum(measure).alias("total"), F.count("*").alias("n_items"), greatest.alias("_g"))
    return sums.select(repo, "total", "n_items", F.round(F.col("total") / F.col("n_items"), 6).alias("average"), F.col("_g._value").alias("greatest"), (-F.col("_g._item")).alias("greatest_item"))


def mirrors(rows: DataFrame, digest: Column, repo: str) -> DataFrame:
    """Contents found in two repositories or more: (digest, n_repos, n_rows); n_repos - 1 of them are excess copies."""
    pairs = rows.groupBy(digest.alias("digest"), repo).agg(F.count("*").alias("_n"))
    return pairs.groupBy("digest").agg(F.count("*").alias("n_repos"), F.sum("_n").alias("n_rows")).filter("n_repos > 1")


def co_occurrence(rows: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """(a, b, n): how many keys have both idents, a before b.

    A key's different idents are gathered once (rules are few), and pairs are made within the row.
    """
    sets = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(ident)).alias("_s")).filter(F.size("_s") > 1)
    pairs = F.flatten(F.transform("_s", lambda a: F.transform(F.filter("_s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def cross_tab(rows: DataFrame, ident: str, status: str, values: list[str]) -> DataFrame:
    """(ident, a count for each value): values are named, so no job looks for them."""
    return rows.groupBy(ident).agg(*[F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values])


def gap_rate(gaps: DataFrame, fixed: DataFrame, ident: str) -> DataFrame:
    """Per ident: gap / (gap + fixed), idents of either side kept."""
    sides = gaps.select(ident, F.lit(1).alias("g"), F.lit(0).alias("f")).unionAll(fixed.select(ident, F.lit(0), F.lit(1)))
    sums = sides.groupBy(ident).agg(F.sum("g").alias("n_gap"), F.sum("f").alias("n_fixed"))
    return sums.withColumn("rate", F.round(F.col("n_gap") / (F.col("n_gap") + F.col("n_fixed")), 6))


def outcome_bucket(status: Column, oracle_ok: Column, lint_ok: Column, landed: Column, review: Column, failed: Column, introduced: Column) -> Column:
    """The capability bucket of a patched target: the first that holds."""
    return (
        F.when(status != "patched", "fetch_or_compile_error")
        .when(oracle_ok & lint_ok, "accepted")
        .when((landed == 0) & (review > 0), "needs_review_only")
        .when(landed == 0, "no_landed_edits")
        .when(~lint_ok, "failed_actionlint")
        .when(failed > 0, "failed_zizmor_local")
        .when(introduced > 0, "regression_in_scope")
        .otherwise("other")
    )


def oracle_counters(runs: DataFrame) -> DataFrame:
    """One row: targets, those patched, those each oracle passes, accepted ones, and those left to review."""
    n = F.count_if
    return runs.agg(F.count("*").alias("n"), n(F.col("status") == "patched").alias("n_patched"), n("success").alias("n_local_ok"), n((F.col("status") == "patched") & (F.col("n_lint") == 0)).alias("n_lint_ok"), n("accepted").alias("n_accepted"), n(F.col("n_needs_review") > 0).alias("n_review"))


def acceptance_by_rule(rows: DataFrame, idents: str = "target_idents", bucket: str = "bucket") -> DataFrame:
    ruled = rows.select(F.explode(idents).alias("ident"), bucket)
    return ruled.groupBy("ident").agg(F.count("*").alias("n"), F.count_if(F.col(bucket) == "accepted").alias("n_accepted")).withColumn("acceptance", F.round(F.col("n_accepted") / F.col("n"), 6))


def reproduction(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Counts of comparisons with human patches, and how many were reproduced."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(outcome).isin(*REPRODUCED)).alias("n_reproduced"), *[F.count_if(F.col(outcome) == o).alias(f"n_{o}") for o in (*REPRODUCED, "divergent")])


def generator_counts(rows: DataFrame, outcomes: str = "outcomes") -> DataFrame:
    """(generator, outcome, n) of rows with a map from generator to outcome."""
    return rows.select(F.explode(outcomes).alias("generator", "outcome")).groupBy("generator", "outcome").agg(F.count("*").alias("n"))


def excess_copies(mirrored: DataFrame) -> DataFrame:
    """One row: mirrored contents, and the copies beyond the first of each."""
    return mirrored.agg(F.count("*").alias("n_mirrored"), F.coalesce(F.sum(F.col("n_repos") - 1), F.lit(0)).alias("n_excess"))


def ranked(rows: DataFrame, measure: str, keys: list[str], k: int = 20) -> DataFrame:
    """The first k rows by falling measure, with their ``rank``; the limit is a top-k of each task, the rank of k rows."""
    first = rows.orderBy(F.col(measure).desc(), *keys).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.col(measure).desc(), *keys)))


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; where there are more than ``most`` rows, a last line says so."""
    got = rows.limit(most + 1).collect()
    cells = [rows.columns, ["---"] * len(rows.columns), *[["" if v is None else str(v).replace("|", "\\|") for v in r] for r in got[:most]]]
    more = f"\nOnly the first {most} rows are shown.\n" if len(got) > most else ""
    return "\n".join(f"| {' | '.join(r)} |" for r in cells) + "\n" + more
