"""Other ways to carry a fix over, to compare with: copying the changed lines, and bumping versions of actions.

Both are joins: the changed block of a file is one string, looked for in the target's lines; versions meet on the
action's name.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import split_action
from ..functions.dealing import spread


def changed_block(before: str, after: str) -> tuple[list[str], list[str], int]:
    """(old lines, new lines, place in before) of the smallest stretch that holds every change."""
    a, b = before.splitlines(True), after.splitlines(True)
    changes = [c for c in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes() if c[0] != "equal"]
    if not changes:
        return [], [], 0
    return a[changes[0][1] : changes[-1][2]], b[changes[0][3] : changes[-1][4]], changes[0][1]


def replay_hunk(before: str, after: str, target: str) -> tuple[str, str]:
    """(text, status): the block's old lines, found once in the target, become its new ones.

    status: applied, unchanged (no change to carry), not_found, or ambiguous. A pure insertion is anchored by the line
    before it.
    """
    old, new, at = changed_block(before, after)
    if not old and not new:
        return target, "unchanged"
    if not old:
        lines = before.splitlines(True)
        old, new = (lines[at - 1 : at], lines[at - 1 : at] + new) if at else (lines[:1], new + lines[:1])
    there = target.splitlines(True)
    places = [i for i in range(len(there) - len(old) + 1) if there[i : i + len(old)] == old] if old else []
    if len(places) != 1:
        return target, "ambiguous" if places else "not_found"
    return "".join(there[: places[0]] + new + there[places[0] + len(old) :]), "applied"


def copy_paste(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, patched_text, status) of rows (keys, before, after, target)."""
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [replay_hunk(b or "", a or "", t or "") for b, a, t in zip(batch["before"], batch["after"], batch["target"], strict=True)]
            yield batch[keys].assign(patched_text=[d[0] for d in done], status=[d[1] for d in done])

    return spread(rows.select(*keys, "before", "after", "target")).mapInPandas(run, f"{schema}, patched_text string, status string")


def outputs(rows: DataFrame, keys: list[str], patched: DataFrame | None = None) -> DataFrame:
    """(keys, generator, output): what each generator makes of rows (keys, before, after, target), null if nothing.

    ``patched``: (keys, patched_text) of the patch engine, run once and taken over as it is.
    """
    from ..functions.trees import document_nodes
    from .lineage import settle
    from .patches import patched_texts

    nodes = lambda c: settle(document_nodes(rows, keys, text=c))
    sites = settle(bump_sites(version_bumps(nodes("before"), nodes("after"), keys), nodes("target"), rows.select(*keys), keys, keys))
    bumped = patched_texts(rows.select(*keys, F.col("target").alias("text")), sites, keys, keys)
    asked = rows.select(*keys)
    of = lambda name, texts: asked.join(texts.select(*keys, F.col("patched_text").alias("output")), keys, "left").select(*keys, F.lit(name).alias("generator"), "output")
    out = of("hunk", copy_paste(rows, keys)).unionAll(of("bump", bumped))
    return out if patched is None else out.unionAll(of("patch", patched))


def version_bumps(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, action, new_ref) of actions whose reference changed, from nodes of both versions; the last place wins."""
    uses = lambda n, c: n.filter((F.try_element_at("segments", F.lit(-1)) == "uses") & (F.col("kind") == "str")).select(*keys, F.array_join("segments", "\x1f").alias("_name"), "ordinal", F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v").alias(c))
    nodes = lambda n: n.filter(F.size("segments") > 0)
    met = uses(nodes(before), "_old").drop("ordinal").join(uses(nodes(after), "_new"), [*keys, "_name"])
    (old_action, old_ref), (action, ref) = split_action(F.col("_old")), split_action(F.col("_new"))
    changed = met.filter((old_action == action) & (old_ref != ref))
    return changed.groupBy(*keys, action.alias("action")).agg(F.max_by(ref, "ordinal").alias("new_ref"))


def bump_sites(bumps: DataFrame, targets: DataFrame, pairs: DataFrame, program: list[str], target: list[str]) -> DataFrame:
    """Where versions are bumped on targets: rows as patched_texts() takes them."""
    uses = targets.filter((F.size("segments") > 0) & (F.try_element_at("segments", F.lit(-1)) == "uses") & (F.col("kind") == "str"))
    text = F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")
    action, ref = split_action(text)
    there = uses.select(*target, "ordinal", F.slice("path", 1, F.size("path") - 1).alias("path"), F.regexp_replace("route", r"\.?uses$", "").alias("route"), action.alias("action"), ref.alias("_ref"))
    met = bumps.join(pairs, program).join(there, [*target, "action"]).filter("_ref <> new_ref")
    value = F.concat(F.lit('"'), "action", F.lit("@"), "new_ref", F.lit('"'))
    return met.select(*program, *[c for c in target if c not in program], "ordinal", "path", "route", F.array().cast("array<string>").alias("missing"), F.lit("set").alias("write"), F.lit("uses").alias("key"), value.alias("new_value"), F.lit(None).cast("string").alias("note"))
