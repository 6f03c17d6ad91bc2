"""URL filter by a path-template tree, in DataFrame functions alone.

1. A url's host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
   its path is what then stands up to ``?``, ``#`` or the end.
2. Rules (host and path, as ``example.org/es/``) fit a host and all its subdomains where the path starts with
   the rule's. The longest rule that fits decides; such urls are also the labelled examples of the tree.
3. The other urls are judged by a tree of templates for each host. A path's segments are its levels, down to
   DEPTH; what is deeper is one last level. Segments that are numbers, hashes, dates or very long become ``*``
   at once. Level by level, a node's children become ``*`` as well where there are at least VARIETY of them
   and more than SHARE of its pages each have one of their own.
4. Children of a node whose share of blocked examples doesn't differ from the node's own by more than Z
   standard errors are statistically similar; they're merged into one branch, ``~``, and share its examples.
5. A branch's purity is its share of blocked examples, smoothed by STRENGTH examples of its parent's purity; a
   host's, likewise, by that of all hosts, and that by PRIOR. A template whose purity is over THRESHOLD is
   rejected: its urls get ``block``.

Counts are taken of (host, lexical template) first, so that a host with a third of all urls is summed before
it moves; the tree then has a row for each template, not for each url.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is judged as a host
of its own; null page_ids stay; repeated rows count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, materialise

#: The rules that come first, as (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DEPTH = 4
VARIETY = 8
SHARE = 0.5
Z = 2.0
STRENGTH = 4.0
PRIOR = 0.25
THRESHOLD = 0.5
#: Segments that vary by their form: digits with any ending, hexadecimal hashes and UUIDs, dates, more than 40 characters.
VARIABLE = r"^([0-9]+([.].*)?|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{2}(-[0-9]{2})?|.{41,})$"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    when = lambda i: reduce(lambda c, r: c.when(fits(r[1], host, path), F.lit(r[i])), ordered, F.when(F.lit(False), F.lit("")))
    return when(1), when(0)


def lexical_template(path: Column, depth: int = DEPTH) -> Column:
    """The path's segments as an array of at most depth + 1 strings; segments of variable form are ``*``."""
    parts = F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))
    return F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.lit("**")))).otherwise(parts)


def generalise(templates: DataFrame, depth: int = DEPTH) -> DataFrame:
    """templates (host, lexical, pages, ...) with ``node``: the segments after children of varied nodes became ``*``.

    Level by level: the node above, as generalised so far, its children and their pages.
    """
    out = templates.withColumn("node", F.lit(""))
    for level in range(1, depth + 2):
        segment = F.get("lexical", F.lit(level - 1))
        there = out.withColumn("_segment", segment)
        children = there.filter(F.col("_segment").isNotNull()).groupBy("host", "node", "_segment").agg(F.sum("pages").alias("_pages"))
        varied = children.groupBy("host", "node").agg(F.count("*").alias("_children"), F.sum("_pages").alias("_pages"))
        varied = varied.filter((F.col("_children") >= VARIETY) & (F.col("_children") > F.lit(SHARE) * F.col("_pages"))).select("host", "node", F.lit(True).alias("_varied"))
        there = there.join(varied, ["host", "node"], "left")
        name = F.when(F.col("_varied"), F.lit("*")).otherwise(F.col("_segment"))
        out = there.withColumn("node", F.when(F.col("_segment").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), name))).drop("_segment", "_varied")
        out = materialise(out)  # each level reads the one above twice; uncut, the plan would double with each
    return out


def judge_templates(templates: DataFrame, depth: int = DEPTH) -> DataFrame:
    """templates (host, node, allowed, blocked) -> (host, node, purity), similar branches merged level by level."""
    rows = templates.groupBy("host", "node").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    rows = materialise(rows.withColumn("_parts", F.split(F.col("node"), "/")))
    total = rows.agg(F.sum("allowed").alias("_a"), F.sum("blocked").alias("_b"))
    root = total.select(((F.coalesce("_b", F.lit(0)) + STRENGTH * PRIOR) / (F.coalesce(F.col("_a") + F.col("_b"), F.lit(0)) + STRENGTH)).alias("_root"))
    hosts = rows.groupBy("host").agg(F.sum("allowed").alias("_a"), F.sum("blocked").alias("_b")).crossJoin(F.broadcast(root))  # root is one row
    hosts = hosts.select("host", ((F.col("_b") + STRENGTH * F.col("_root")) / (F.col("_a") + F.col("_b") + STRENGTH)).alias("purity"))
    rows = rows.join(hosts, "host").withColumn("branch", F.lit(""))
    for level in range(1, depth + 2):
        there = rows.withColumn("_child", F.get("_parts", F.lit(level)))
        sums = there.filter(F.col("_child").isNotNull()).groupBy("host", "branch", "_child").agg(F.sum("allowed").alias("_a"), F.sum("blocked").alias("_b"), F.first("purity").alias("_above"))
        n = F.col("_a") + F.col("_b")
        # With the node's own purity p, a child's blocked examples have mean n p and variance n p (1 - p).
        off = F.pow(F.col("_b") - n * F.col("_above"), 2) > F.lit(Z * Z) * n * F.col("_above") * (1 - F.col("_above"))
        sums = materialise(sums.withColumn("_name", F.when(off, F.col("_child")).otherwise(F.lit("~"))))
        merged = sums.groupBy("host", "branch", "_name").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), F.first("_above").alias("_above"))
        merged = merged.select("host", "branch", "_name", ((F.col("_b") + STRENGTH * F.col("_above")) / (F.col("_a") + F.col("_b") + STRENGTH)).alias("_purity"))
        named = sums.select("host", "branch", "_child", "_name").join(merged, ["host", "branch", "_name"])
        rows = there.join(named, ["host", "branch", "_child"], "left")
        rows = rows.withColumn("purity", F.coalesce("_purity", "purity")).withColumn("branch", F.when(F.col("_name").isNotNull(), F.concat("branch", F.lit("/"), "_name")).otherwise(F.col("branch")))
        rows = materialise(rows.drop("_child", "_name", "_purity"))
    return rows.select("host", "node", "branch", "purity")


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, depth: int = DEPTH, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each row of ``pages`` (page_id, url)."""
    url = F.col("url").cast("string")
    split = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = materialise(split.withColumns({"rule": rule, "_verdict": verdict, "lexical": lexical_template(F.col("path"), depth)}))
    templates = ruled.groupBy("host", "lexical").agg(F.count("*").alias("pages"), F.count_if(F.col("_verdict") == "allow").alias("allowed"), F.count_if(F.col("_verdict") == "block").alias("blocked"))
    templates = generalise(materialise(templates), depth)
    judged = judge_templates(templates, depth)
    known = templates.select("host", "lexical", "node").join(judged, ["host", "node"])
    return ruled.join(known, ["host", "lexical"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("_verdict", F.when(F.col("purity") > threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("node").alias("template"), "purity",
    )
