"""Differences between two versions, of path maps and of findings, and the commits they make clean fixes.

Both sides meet in one aggregation: rows of either side are tagged and grouped by what identifies them, so one
shuffle, combined before it moves, does what two anti joins or a full outer join would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def consecutive_sides(facts: DataFrame, entity: list[str], order: str) -> DataFrame:
    """facts twice: as what a version has (``is_after``), and as what the entity's next version had before it.

    Rows come under the later version's order; first versions have no before, so they give no step. The window runs
    over different versions alone, and facts meet them in one join.
    """
    by = Window.partitionBy(*entity).orderBy(order)
    versions = facts.select(*entity, order).distinct().withColumns({"_before": F.lag(order).over(by), "_next": F.lead(order).over(by)})
    met = facts.join(versions, [*entity, order])
    after = F.struct(F.when(F.col("_before").isNotNull(), F.col(order)).alias("at"), F.lit(True).alias("is_after"))
    sides = F.filter(F.array(after, F.struct(F.col("_next").alias("at"), F.lit(False).alias("is_after"))), lambda s: s["at"].isNotNull())
    rest = [c for c in facts.columns if c not in (*entity, order)]
    return met.select(*entity, *rest, F.explode(sides).alias("_s")).select(*entity, F.col("_s.at").alias(order), *rest, "_s.is_after")


def both_sides(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of both versions, tagged by ``is_after``."""
    return before.withColumn("is_after", F.lit(False)).unionByName(after.withColumn("is_after", F.lit(True)))


def path_changes(sides: DataFrame, keys: list[str], path: str = "path", leaf: str = "leaf", equal: str | None = None) -> DataFrame:
    """(keys, path, change, old, new) of tagged rows: paths added, removed, or with another leaf.

    ``equal``: the field of a struct leaf that alone says whether leaves are equal.
    """
    compared = f"v.{equal}" if equal else "v"
    pick = lambda new: F.max(F.when(F.col("is_after") == new, F.struct(F.col(leaf).alias("v"))))  # noqa: E731  a struct, as leaves may be null
    met = sides.groupBy(*keys, path).agg(pick(False).alias("_old"), pick(True).alias("_now"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_now").isNull(), "removed").when(~F.col(f"_old.{compared}").eqNullSafe(F.col(f"_now.{compared}")), "changed")
    return met.select(*keys, path, change.alias("change"), F.col("_old.v").alias("old"), F.col("_now.v").alias("new")).filter("change is not null")


def finding_changes(sides: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """(keys, identity, side) of tagged rows: findings only before are ``fixed``, those only after ``introduced``."""
    one = F.col("is_after").cast("int")
    met = sides.groupBy(*keys, *identity).agg(F.max(1 - one).alias("_b"), F.max(one).alias("_a")).filter("_a <> _b")
    return met.select(*keys, *identity, F.when(F.col("_b") == 1, "fixed").otherwise("introduced").alias("side"))


def diff_path_maps(before: DataFrame, after: DataFrame, keys: list[str], path: str = "path", leaf: str = "leaf", equal: str | None = None) -> DataFrame:
    columns = [*keys, path, leaf]
    return path_changes(both_sides(before.select(columns), after.select(columns)), keys, path, leaf, equal)


def diff_findings(before: DataFrame, after: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    columns = [*keys, *identity]
    return finding_changes(both_sides(before.select(columns), after.select(columns)), keys, identity)


def join_scans(files: DataFrame, scans: DataFrame) -> DataFrame:
    """File-diffs with the findings of both versions; ``incomplete`` where either wasn't scanned well."""
    ok = scans.filter("ok").select("file_hash", "findings")
    after = ok.withColumnRenamed("findings", "after")
    before = ok.select(F.col("file_hash").alias("previous_file_hash"), F.col("findings").alias("before"))
    joined = files.join(before, "previous_file_hash", "left").join(after, "file_hash", "left")
    return joined.withColumn("scan_status", F.when(F.col("before").isNull() | F.col("after").isNull(), "incomplete").otherwise("ok"))


def identities(findings: Column) -> Column:
    """What of findings is compared between versions."""
    return F.array_distinct(F.transform(findings, lambda f: F.struct(f["ident"].alias("ident"), F.coalesce(f["route"], F.lit("")).alias("route"))))


def file_findings(scanned: DataFrame) -> DataFrame:
    """What each well-scanned file-diff fixed and introduced, by arrays alone: no shuffle."""
    return _compared(scanned.withColumns({c: identities(F.col(c)) for c in ("before", "after")}))


def judged_files(files: DataFrame, scans: DataFrame) -> DataFrame:
    """``file_findings`` of file-diffs and scans; what is compared is made once for each scan, before files meet it."""
    return _compared(join_scans(files, scans.withColumn("findings", identities(F.col("findings")))))


def _compared(scanned: DataFrame) -> DataFrame:
    ok = F.col("scan_status") == "ok"
    fixed = F.when(ok, F.array_sort(F.array_except("before", "after")))
    introduced = F.when(ok & F.col("after").isNotNull(), F.array_sort(F.array_except("after", "before")))
    return scanned.withColumns({"V_fixed": fixed, "V_introduced": introduced}).drop("before", "after")


def commit_roll_up(files: DataFrame) -> DataFrame:
    """Commits with the union of their files' findings; incomplete files add none."""
    detail = F.struct("file_path", "previous_file_hash", "file_hash", "scan_status", "V_fixed", "V_introduced")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(c), F.array().cast("array<struct<ident:string,route:string>>"))))))
    grouped = files.groupBy("repository", "commit_hash").agg(union("V_fixed").alias("V_fixed"), union("V_introduced").alias("V_introduced"), F.sort_array(F.collect_list(detail)).alias("files"), F.count("*").alias("n_files_modified"))
    return grouped.withColumns({"V_fixed_count": F.size("V_fixed"), "V_fixed_idents": F.array_sort(F.array_distinct(F.transform("V_fixed", lambda f: f["ident"])))})


def clean_fixes(commits: DataFrame) -> DataFrame:
    """Commits that fixed something and introduced nothing."""
    return commits.filter((F.size("V_fixed") > 0) & (F.size("V_introduced") == 0))


def fix_variants(changes: DataFrame, keys: list[str], ident: str = "ident") -> DataFrame:
    """Per key: which clean-fix predicates hold, from rows (keys, ident, side).

    strict: nothing introduced. loose_a: introduced idents are among the fixed. loose_b: no ident is introduced
    more often than fixed. loose_c: something is fixed.
    """
    counts = changes.groupBy(*keys, ident).agg(F.count_if(F.col("side") == "fixed").alias("_f"), F.count_if(F.col("side") == "introduced").alias("_i"))
    fixed = F.sum("_f") > 0
    return counts.groupBy(*keys).agg(
        (fixed & (F.sum("_i") == 0)).alias("strict"),
        (fixed & F.bool_and((F.col("_i") == 0) | (F.col("_f") > 0))).alias("loose_a"),
        (fixed & F.bool_and(F.col("_i") <= F.col("_f"))).alias("loose_b"),
        fixed.alias("loose_c"),
    )


def occurrence_index(rows: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """Add ``occurrence``: how many equal ones stand before a row."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1)


def normalise_findings(findings: Column) -> Column:
    """Raw findings with their first location as (ident, severity, confidence, route); what's missing is empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.transform(findings, lambda f: F.struct(text(f["ident"]).alias("ident"), text(f["severity"]).alias("severity"), text(f["confidence"]).alias("confidence"), text(F.get(f["routes"], F.lit(0))).alias("route")))
