"""Semantic patches as relations: fixes compiled to edits, edits resolved on drifted targets, and their outcomes.

An edit says what must hold at an anchor: a place named by keys and by the identities of list elements, with any
job under ``jobs``. So compiling is a difference of path maps, resolving is an equi-join of anchors with the nodes
of the target, and only writing the patched text is done row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import SHA, split_action, value_sketch
from ..functions.dealing import spread
from ..functions.trees import KEPT_CHARS, kept_rewrite, rewrite
from .diffs import diff_path_maps
from .lineage import settle, unsized

#: Operations of an edit and what becomes of it.
PRESENT, ABSENT, REWRITE = "ensure_present", "ensure_absent", "rewrite_value"
APPLIED, CREATED, NOOP, INAPPLICABLE, REVIEW = "applied", "created", "noop", "inapplicable", "needs_review"
EDIT = ["ordinal", "op", "anchor", "key", "value", "pin_action", "expected_old", "review"]
SEP = "\x1f"


def name_of(segments: Column) -> Column:
    return F.array_join(segments, SEP)


def anchor_pattern(segments: Column) -> Column:
    """Segments with any job's name as ``$JOB`` and without the numbers of equal list elements."""
    job = lambda s, i: (i > 0) & (F.get(segments, i - 1) == "jobs") & ~s.startswith("[")
    return F.transform(segments, lambda s, i: F.when(job(s, i), F.lit("$JOB")).otherwise(F.regexp_replace(s, r"~\d+\]$", "]")))


def _prefixes(segments: Column, least: int = 1) -> Column:
    """All proper prefixes of at least ``least`` segments."""
    return F.when(F.size(segments) > least, F.transform(F.sequence(F.lit(least), F.size(segments) - 1), lambda n: F.slice(segments, 1, n))).otherwise(F.array().cast("array<array<string>>"))


def _elements(nodes: DataFrame) -> DataFrame:
    """Nodes that are list elements: every element that a path leads through is a node itself."""
    return nodes.filter(F.try_element_at("segments", F.lit(-1)).startswith("["))


def _leaves(nodes: DataFrame, keys: list[str]) -> DataFrame:
    leaf = F.struct("eq", "value", "kind", "segments")
    return nodes.filter(~F.col("kind").isin("map", "list") & (F.size("segments") > 0)).select(*keys, name_of(F.col("segments")).alias("path"), leaf.alias("leaf"))


def compile_edits(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, EDIT) of programs from the nodes of both versions (``document_nodes`` under the program's keys)."""
    before, after = settle(unsized(before)), settle(unsized(after))
    changes = diff_path_maps(_leaves(before, keys), _leaves(after, keys), keys, equal="eq")
    changes = settle(changes.withColumn("segments", F.coalesce("new.segments", "old.segments")))
    plain = ~F.exists("segments", lambda s: s.startswith("["))

    # A key whose value turned from scalar to complex, or back, is one rewrite of it; what lies below is left out.
    above = lambda c: c.select(*keys, F.explode(_prefixes(F.col("segments"))).alias("_p")).select(*keys, name_of(F.col("_p")).alias("path")).distinct()
    added, removed = changes.filter("change = 'added'"), changes.filter("change = 'removed'")
    turned = removed.filter(plain).select(*keys, "path", "segments").join(above(added), [*keys, "path"], "left_semi").withColumn("_to", F.lit("complex"))
    turned = turned.unionAll(added.filter(plain).select(*keys, "path", "segments").join(above(removed), [*keys, "path"], "left_semi").withColumn("_to", F.lit("scalar")))
    whole = lambda n, c: n.filter(plain).select(*keys, name_of(F.col("segments")).alias("path"), F.col("value").alias(c), F.col("kind").alias(f"{c}_kind"))
    rewrites = turned.join(whole(before, "_old"), [*keys, "path"], "left").join(whole(after, "_new"), [*keys, "path"], "left")
    rewrites = settle(rewrites.filter(F.col("_new").isNotNull()))
    covered = changes.filter("change <> 'changed'").select(*keys, "path", "segments", F.explode(F.concat(_prefixes(F.col("segments")), F.array("segments"))).alias("_p"))
    covered = covered.withColumn("_over", name_of(F.col("_p"))).join(rewrites.select(*keys, F.col("path").alias("_over")), [*keys, "_over"], "left_semi").select(*keys, "path").distinct()
    kept = settle(changes.join(covered, [*keys, "path"], "left_anti"))

    # List elements that only one side has can't be put in or taken out of a target's list.
    element = lambda c: c.select(*keys, "path", F.explode(F.concat(_prefixes(F.col("segments")), F.array("segments"))).alias("_p")).filter(F.try_element_at("_p", F.lit(-1)).startswith("[")).select(*keys, "path", name_of(anchor_pattern(F.col("_p"))).alias("_e"))
    known = lambda n: _elements(n).select(*keys, name_of(anchor_pattern(F.col("segments"))).alias("_e")).distinct()
    new = element(kept.filter("change = 'added'")).join(known(before), [*keys, "_e"], "left_anti").select(*keys, "path", F.lit("adds a list element").alias("_element"))
    gone = element(kept.filter("change = 'removed'")).join(known(after), [*keys, "_e"], "left_anti").select(*keys, "path", F.lit("removes a list element").alias("_element"))
    kept = kept.join(new.unionAll(gone).distinct(), [*keys, "path"], "left")

    sketch = lambda c: F.when(F.col(f"{c}.kind").isNotNull(), value_sketch(F.col(f"{c}.kind"), scalar_text(F.col(f"{c}.value"), F.col(f"{c}.kind"))))
    op = F.when(F.col("change") == "added", PRESENT).when(F.col("change") == "removed", ABSENT).otherwise(REWRITE)
    leaves = kept.select(*keys, "segments", op.alias("op"), F.when(F.col("change") != "removed", F.col("new.value")).alias("value"), F.when(F.col("change") == "changed", F.col("old.value")).alias("_was"), F.when(F.col("change") == "changed", sketch("old")).alias("expected_old"), "_element")
    shape = F.when(F.col("_old_kind").isin("map", "list"), F.lit("<complex>")).otherwise(value_sketch(F.col("_old_kind"), scalar_text(F.col("_old"), F.col("_old_kind"))))
    wholes = rewrites.select(*keys, "segments", F.lit(REWRITE).alias("op"), F.col("_new").alias("value"), F.lit(None).cast("string").alias("_was"), shape.alias("expected_old"), F.lit(None).cast("string").alias("_element"))

    edits = leaves.unionByName(wholes).withColumn("key", F.try_element_at("segments", F.lit(-1))).withColumn("anchor", F.slice(anchor_pattern(F.col("segments")), 1, F.size("segments") - 1))
    action, ref = split_action(F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v"))
    pinned = (F.col("op") == REWRITE) & (F.col("key") == "uses") & F.col("_was").startswith('"') & F.col("value").startswith('"') & (action != "") & ref.rlike(SHA)
    review = F.coalesce(F.when(F.col("key").startswith("["), "list elements themselves aren't edited"), F.col("_element"))
    edits = edits.withColumn("pin_action", F.when(F.coalesce(pinned, F.lit(False)), action)).withColumn("review", review)
    rank = F.when(F.col("op") == PRESENT, 0).when(F.col("op") == ABSENT, 1).otherwise(2)
    ordinal = F.row_number().over(Window.partitionBy(*keys).orderBy(rank, name_of(F.col("segments"))))
    return settle(edits.withColumn("ordinal", ordinal).select(*keys, *EDIT))


def scalar_text(value: Column, kind: Column) -> Column:
    """A scalar's JSON as text: strings without quotes, booleans as Python writes them."""
    text = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    return F.when(kind == "bool", F.initcap(value)).when(kind == "str", text).otherwise(value)


def resolve(edits: DataFrame, targets: DataFrame, program: list[str], target: list[str]) -> DataFrame:
    """Sites of edits: (program, target, EDIT, path and route of the container, missing keys, weak, current value).

    edits: one row an edit and target (program and target columns both there). targets: nodes under ``target``.
    An edit without a site gives one row with a null route.
    """
    keys, targets = [*program, *[c for c in target if c not in program]], settle(unsized(targets))
    # An element is weakly named if its list has others that look the same, or if only running identifies it.
    elements = _elements(targets).select(*target, "segments", "path", F.try_element_at(anchor_pattern(F.col("segments")), F.lit(-1)).alias("_last"))
    alike = Window.partitionBy(*target, name_of(F.slice("segments", 1, F.size("segments") - 1)), "_last")
    unsure = (F.count("*").over(alike) > 1) | F.col("_last").isin("[run]", "[anon]")
    doubtful = elements.withColumn("_unsure", unsure).filter("_unsure").select(*target, name_of(F.col("path")).alias("_e"))
    places = targets.select(*target, "path", "route", "kind", name_of(anchor_pattern(F.col("segments"))).alias("_anchor"))

    # Each prefix of an anchor whose rest is mapping keys: where it ends, the rest would have to be made.
    rest = F.filter(F.sequence(F.lit(0), F.size("anchor")), lambda n: ~F.exists(F.slice("anchor", n + 1, F.size("anchor")), lambda s: s.startswith("[") | s.startswith("$")))
    asked = edits.filter("review is null").withColumn("_n", F.explode(rest))
    asked = asked.withColumn("_anchor", F.array_join(F.slice("anchor", F.lit(1), F.col("_n")), SEP)).withColumn("missing", F.slice("anchor", F.col("_n") + 1, F.size("anchor")))
    met = asked.join(places, [*target, "_anchor"])
    below = targets.select(*target, name_of(F.col("path")).alias("_child"), F.size("path").alias("_depth"), F.col("value").alias("_value"), F.col("kind").alias("_kind"))
    child = F.concat("path", F.array(F.coalesce(F.get("missing", F.lit(0)), F.col("key"))))
    met = met.withColumn("_child", name_of(child)).withColumn("_depth", F.size("path") + 1).join(below, [*target, "_child", "_depth"], "left")
    sites = met.filter((F.size("missing") == 0) | F.col("_kind").isNull())
    sites = settle(sites.select(*keys, *EDIT, "path", "route", "missing", (F.col("kind") == "map").alias("is_map"), F.when(F.size("missing") == 0, F.col("_value")).alias("current")))
    # A place is known by its path (routes of keys that hold dots may be alike), and weak if that leads through such an element.
    sites = sites.withColumn("_place", name_of(F.col("path")))
    through = F.filter(F.concat(_prefixes(F.col("path")), F.array("path")), lambda p: F.try_element_at(p, F.lit(-1)).startswith("["))
    above = sites.select(*target, "_place", F.explode(through).alias("_p")).select(*target, "_place", name_of(F.col("_p")).alias("_e"))
    weak = above.join(doubtful, [*target, "_e"], "left_semi").select(*target, "_place", F.lit(True).alias("_weak")).distinct()
    nothing = edits.join(sites.select(*keys, "ordinal").distinct(), [*keys, "ordinal"], "left_anti")
    none = lambda t: F.lit(None).cast(t)
    found = sites.join(weak, [*target, "_place"], "left").select(*keys, *EDIT, "path", "route", "missing", F.coalesce("_weak", F.lit(False)).alias("weak"), "is_map", "current")
    return found.unionByName(nothing.select(*keys, *EDIT, none("array<string>").alias("path"), none("string").alias("route"), none("array<string>").alias("missing"), F.lit(False).alias("weak"), none("boolean").alias("is_map"), none("string").alias("current")))


def judge_sites(sites: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """Sites with what to do there: ``write`` (set, remove or null), ``new_value``, ``note`` and ``reason``.

    pins: (action, ref, sha). A pin keeps the target's own version: its reference becomes that reference's hash.
    """
    text = F.get_json_object(F.concat(F.lit('{"v":'), "current", F.lit("}")), "$.v")
    _, ref = split_action(text)
    sites = sites.withColumn("_ref", F.when(F.col("pin_action").isNotNull() & text.contains("@"), ref))
    if pins is not None:
        sites = sites.join(pins.select(F.col("action").alias("pin_action"), F.col("ref").alias("_ref"), F.col("sha").alias("_sha")), ["pin_action", "_ref"], "left")
    else:
        sites = sites.withColumn("_sha", F.lit(None).cast("string"))
    pin = F.col("pin_action").isNotNull()
    at = F.col("route").isNotNull() & F.coalesce("is_map", F.lit(False))
    done = pin & F.coalesce(F.col("_ref").rlike(SHA), F.lit(False))
    value = F.when(pin, F.concat(F.lit('"'), "pin_action", F.lit("@"), "_sha", F.lit('"'))).otherwise(F.col("value"))
    differs = ~F.col("current").eqNullSafe(value)
    made = F.size("missing") > 0
    write = (
        F.when(~at | done, F.lit(None))
        .when((F.col("op") == PRESENT) & differs, "set")
        .when((F.col("op") == ABSENT) & ~made & F.col("current").isNotNull(), "remove")
        .when((F.col("op") == REWRITE) & ~made & F.col("current").isNotNull() & value.isNotNull() & differs, "set")
    )
    reason = F.when(at & F.col("weak"), "weak anchor").when(at & pin & ~done & F.col("current").isNotNull() & F.col("_sha").isNull(), F.concat(F.lit("unresolved pin "), "pin_action", F.lit("@"), F.coalesce("_ref", F.lit("?"))))
    return sites.withColumns({"write": write, "new_value": value, "note": F.when(pin, F.col("_ref")), "reason": reason})


def edit_outcomes(judged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ordinal, op, status, sites, reason, site_paths) of each edit."""
    rest = F.array_join(F.concat(F.coalesce("missing", F.array().cast("array<string>")), F.array("key")), ".")
    path = F.when(F.col("route") == "", rest).otherwise(F.concat("route", F.lit("."), rest))
    useful = F.col("route").isNotNull() & ((F.size("missing") == 0) | (F.col("op") == PRESENT))
    made = F.bool_or(F.col("write").isNotNull() & (F.size("missing") > 0))
    grouped = judged.groupBy(*keys, "ordinal", "op", "review").agg(
        F.count("write").alias("sites"), F.bool_or(F.col("route").isNotNull()).alias("_found"), F.bool_or(F.coalesce("is_map", F.lit(False))).alias("_map"), made.alias("_made"),
        F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("_reason"), F.array_sort(F.collect_set(F.when(useful, path))).alias("site_paths"),
    )
    status = (
        F.when(F.col("review").isNotNull(), REVIEW).when(~F.col("_found"), INAPPLICABLE).when(~F.col("_map"), INAPPLICABLE)
        .when(F.col("_reason") != "", REVIEW).when((F.col("sites") > 0) & F.col("_made"), CREATED).when(F.col("sites") > 0, APPLIED).otherwise(NOOP)
    )
    reason = F.coalesce("review", F.when(~F.col("_found"), "anchor not found on target").when(~F.col("_map"), "container_not_mapping").when(F.col("_reason") != "", F.col("_reason")))
    return grouped.select(*keys, "ordinal", "op", status.alias("status"), "sites", reason.alias("reason"), "site_paths")


def patched_texts(targets: DataFrame, judged: DataFrame, target: list[str], keys: list[str], text: str = "text") -> DataFrame:
    """(keys, patched_text) of targets (target columns and text): each text with its sites' operations done in order."""
    place = F.concat("path", F.coalesce("missing", F.array().cast("array<string>")))
    step = F.struct("ordinal", place.alias("place"), F.col("write").alias("op"), "key", "new_value", "note")
    # A target has few operations, so that they are one row's list.
    todo = judged.filter("write is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(step)).alias("_todo"))
    rows = judged.select(*keys).distinct().join(todo, keys, "left").join(unsized(targets.select(*target, F.col(text).alias("_text"))), target)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for steps, body in zip(batch["_todo"], batch["_text"], strict=True):
                steps = () if steps is None else tuple((tuple(s["place"]), s["op"], s["key"], s["new_value"], s["note"]) for s in steps)
                done.append((kept_rewrite if len(body or "") <= KEPT_CHARS else rewrite)(body or "", steps) if steps else body)
            yield batch[keys].assign(patched_text=done)

    return spread(rows).mapInPandas(write, f"{schema}, patched_text string")


def apply_programs(edits: DataFrame, pairs: DataFrame, texts: DataFrame, nodes: DataFrame, program: list[str], target: list[str], pins: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(patched texts, edit outcomes) of programs on targets.

    pairs: (program, target) to be tried. A target without a program gives no row; that is a left join on pairs.
    """
    keys = [*program, *[c for c in target if c not in program]]
    judged = settle(judge_sites(resolve(edits.join(unsized(pairs), program), nodes, program, target), pins))
    return patched_texts(texts, judged, target, keys), edit_outcomes(judged, keys)


def run_summary(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status, and whether a target changed, needs review, or has every edit in place."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    sums = outcomes.groupBy(*keys).agg(F.count("*").alias("n_edits"), *[n(s).alias(f"n_{s}") for s in (APPLIED, CREATED, NOOP, INAPPLICABLE, REVIEW)])
    return sums.withColumns({"changed": F.col("n_applied") + F.col("n_created") > 0, "needs_review": F.col("n_needs_review") > 0, "fully_applied": F.col("n_applied") + F.col("n_created") + F.col("n_noop") == F.col("n_edits")})


def postconditions(outcomes: DataFrame, judged_again: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, holds): on the patched text, resolved anew, no landed edit has anything left to do."""
    left = judged_again.filter("write is not null").groupBy(*keys, "ordinal").agg(F.count("*").alias("_left"))
    landed = outcomes.filter(F.col("status").isin(APPLIED, CREATED, NOOP)).join(left, [*keys, "ordinal"], "left")
    return landed.groupBy(*keys).agg(F.bool_and(F.col("_left").isNull()).alias("holds"))
