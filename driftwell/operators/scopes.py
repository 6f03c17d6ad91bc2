"""Oracles as set algebra on findings: did a patch fix what it touched, and break nothing?

A finding's candidate scopes are few: itself cut back at each dot and bracket, down to the root. So "lies in the
scope" is an equi-join on those prefixes, not a join on a condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def enclosing(route: Column) -> Column:
    """All prefixes of a route that end before a dot or bracket, the route and the root ('')."""
    ends = F.filter(F.sequence(F.lit(1), F.char_length(route)), lambda i: F.substr(route, i, F.lit(1)).isin(".", "["))
    cut = F.transform(ends, lambda i: F.substr(route, F.lit(1), i - 1))
    return F.array_distinct(F.concat(F.array(F.lit(""), route), F.coalesce(cut, F.array().cast("array<string>"))))


def in_scope(findings: DataFrame, scopes: DataFrame, keys: list[str], route: str = "route", scope: str = "scope", order: str = "scope_order") -> DataFrame:
    """findings with the first scope (by ``order``) of the same keys that they lie in; others are left out."""
    # Equal findings are counted, so that one that occurs twice is found twice.
    counted = findings.groupBy(*findings.columns).agg(F.count("*").alias("_times"))
    asked = counted.withColumn(scope, F.explode(enclosing(F.coalesce(F.col(route), F.lit("")))))
    met = asked.join(scopes.select(*keys, scope, order), [*keys, scope])
    firsts = met.groupBy(*findings.columns, "_times").agg(F.min(F.struct(order, scope))[scope].alias(scope))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))
    return firsts.select(*findings.columns, scope, again.alias("_time")).drop("_time")


def landed_scopes(outcomes: DataFrame, keys: list[str], scope: Column) -> DataFrame:
    """(keys, scope, scope_order) of edits that landed (applied, created, noop), each scope once, by its first edit."""
    landed = outcomes.filter(F.col("status").isin("applied", "created", "noop"))
    return landed.groupBy(*keys, scope.alias("scope")).agg(F.min("ordinal").alias("scope_order"))


def target_sets(programs: DataFrame, before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, present, absent, resolved, missed): target idents found before or not, and of the found those gone or left."""
    idents = lambda rows, name: rows.groupBy(*keys).agg(F.collect_set("ident").alias(name))
    met = programs.join(idents(before, "_b"), keys, "left").join(idents(after, "_a"), keys, "left")
    none = F.array().cast("array<string>")
    b, a = F.coalesce("_b", none), F.coalesce("_a", none)
    ordered = lambda c: F.array_sort(F.array_distinct(c))
    present = F.array_intersect("target_idents", b)
    return met.select(*keys, ordered(present).alias("present"), ordered(F.array_except("target_idents", b)).alias("absent"), ordered(F.array_except(present, a)).alias("resolved"), ordered(F.array_intersect(present, a)).alias("missed"))


def lint_keys(raw: DataFrame, keys: list[str], faults: str = "faults") -> DataFrame:
    """(keys, kind, message) of a linter's raw answers (kind, message, line, column, ...): places dropped, what's missing empty."""
    at = raw.select(*keys, F.explode(faults).alias("_f"))
    return at.select(*keys, F.coalesce("_f.kind", F.lit("")).alias("kind"), F.coalesce("_f.message", F.lit("")).alias("message"))


def local_oracle(programs: DataFrame, scopes: DataFrame, before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_scopes, n_failed, n_introduced, success) of each target.

    programs: (keys, target_idents). before, after: (keys, ident, route). It succeeds if an edit landed, no target
    ident is left in a landed scope, and nothing in one is new.
    """
    left = in_scope(after, scopes, keys).join(programs, keys)
    failed = left.filter(F.array_contains("target_idents", F.col("ident"))).groupBy(*keys).agg(F.count("*").alias("n_failed"))
    new = after.select(*keys, "ident", "route").distinct().join(before.select(*keys, "ident", "route").distinct(), [*keys, "ident", "route"], "left_anti")
    introduced = in_scope(new, scopes, keys).groupBy(*keys).agg(F.count("*").alias("n_introduced"))
    counted = programs.select(*keys).join(scopes.groupBy(*keys).agg(F.count("*").alias("n_scopes")), keys, "left").join(failed, keys, "left").join(introduced, keys, "left").fillna(0, ["n_scopes", "n_failed", "n_introduced"])
    return counted.withColumn("success", (F.col("n_scopes") > 0) & (F.col("n_failed") == 0) & (F.col("n_introduced") == 0))


def global_oracle(programs: DataFrame, before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_reduced, n_introduced, success): a target ident present before occurs less often, and nothing is new."""
    sides = before.select(*keys, "ident", "route", F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(after.select(*keys, "ident", "route", F.lit(0), F.lit(1)))
    routes = sides.groupBy(*keys, "ident", "route").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    idents = routes.groupBy(*keys, "ident").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("new"))
    judged = programs.join(idents, keys, "left")
    reduced = F.array_contains("target_idents", F.col("ident")) & (F.col("b") > 0) & (F.col("a") < F.col("b"))
    return judged.groupBy(*keys).agg(F.count_if(reduced).alias("n_reduced"), F.coalesce(F.sum("new"), F.lit(0)).alias("n_introduced")).withColumn("success", (F.col("n_reduced") > 0) & (F.col("n_introduced") == 0))


def lint_introduced(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, message) only after the patch; places in the file don't count."""
    cols = [*keys, "kind", "message"]
    return after.select(*cols).distinct().join(before.select(*cols).distinct(), cols, "left_anti")
