"""Whole runs: from the index of commits to differences, the pattern catalog, audits, histories and outcomes.

Every step is a DataFrame over all commits of the run; the commands and the incremental driver are made of these.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import flat_file_name, route_of, set_key
from ..functions.trees import document_nodes
from . import clusters, diffs, gaps, history, hosts
from .lineage import settle
from .patches import scalar_text

COMMIT = ["repository", "commit_hash"]
FILE = [*COMMIT, "file_path"]


def parsed(texts: DataFrame, dialect: str = "1.1") -> DataFrame:
    """Nodes of texts (file_hash, text), each distinct blob parsed once."""
    return settle(document_nodes(texts, ["file_hash"], dialect=dialect))


def _sides(files: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (file_hash, ...) of both versions of each file, tagged by ``is_after``."""
    side = lambda c, after: files.select(*keys, F.col(c).alias("file_hash"), F.lit(after).alias("is_after"))
    both = side("previous_file_hash", False).unionAll(side("file_hash", True))
    return both.join(rows, "file_hash").drop("file_hash")


#: What the changes of a file depend on.
PAIR = ["previous_file_hash", "file_hash"]


def by_content(files: DataFrame, keys: list[str], content: list[str], work: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """``work(files, keys)``, done once for each different content: many commits hold the same pair of blobs.

    work gives rows under the keys that it gets, and for a file looks at ``content`` alone. Files listed more than once
    under their keys are worked on as they are, so that it sees their rows together.
    """
    counted = files.select(*keys, *content).withColumn("_listed", F.count("*").over(Window.partitionBy(*keys)))
    once, more = counted.filter("_listed = 1").drop("_listed"), counted.filter("_listed > 1").drop("_listed")
    names = [f"_content{i}" for i in range(len(content))]
    kinds = once.select(*content).distinct()
    found = work(kinds.select("*", *[F.col(c).alias(n) for c, n in zip(content, names)]), names)
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(content, names)])
    rest = [c for c in found.columns if c not in names]
    return once.join(found, same).select(*keys, *rest).unionByName(work(more, keys))


def document_changes(files: DataFrame, nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, path, change, old, new, old_kind, new_kind) between the two versions of each file."""
    return by_content(files, keys or FILE, PAIR, lambda rows, by: _changes(rows, nodes, by))


def _changes(files: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    leaves = nodes.filter(~F.col("kind").isin("map", "list")).select("file_hash", route_of(F.col("segments")).alias("path"), F.struct("eq", "value", "kind").alias("leaf"))
    found = diffs.path_changes(_sides(files, leaves, keys), keys, equal="eq")
    text = lambda c: scalar_text(F.col(f"{c}.value"), F.col(f"{c}.kind"))
    return found.select(*keys, "path", "change", text("old").alias("old"), text("new").alias("new"), F.col("old.kind").alias("old_kind"), F.col("new.kind").alias("new_kind"))


def _change_maps(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, added, removed, changed): a file's own changes are one row's maps; leaves of one file are few."""
    pairs = lambda kind, value: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("change") == kind, F.struct("path", value.alias("v"))))))
    return changes.groupBy(*keys).agg(
        pairs("added", F.col("new")).alias("added"), pairs("removed", F.col("old")).alias("removed"), pairs("changed", F.array("old", "new")).alias("changed")
    )


def diff_rows(files: DataFrame, nodes: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Rows of the table ``diffs``: a file's changes as maps, and whether neither version could be read.

    Without ``changes`` the maps are made once for each pair of blobs.
    """
    maps = by_content(files, FILE, PAIR, lambda rows, by: _change_maps(_changes(rows, nodes, by), by)) if changes is None else _change_maps(changes, FILE)
    read = nodes.filter(~F.col("kind").isin("map", "list")).select("file_hash").distinct().withColumn("_read", F.lit(True))
    before = read.select(F.col("file_hash").alias("previous_file_hash"), F.col("_read").alias("_before"))
    met = files.join(maps, FILE, "left").join(before, "previous_file_hash", "left").join(read, "file_hash", "left")
    empty = lambda c, kind: F.coalesce(c, F.create_map().cast(kind))
    return met.select(
        *FILE, "file_hash", "previous_file_hash", empty("added", "map<string,string>").alias("added"), empty("removed", "map<string,string>").alias("removed"),
        empty("changed", "map<string,array<string>>").alias("changed"), (F.col("_before").isNull() & F.col("_read").isNull()).alias("parse_error"),
    )


def usable_diffs(rows: DataFrame) -> DataFrame:
    """Diffs that could be read and aren't empty."""
    return rows.filter(~F.col("parse_error") & (F.size("added") + F.size("removed") + F.size("changed") > 0))


def clean_commits(files: DataFrame, scans: DataFrame) -> DataFrame:
    """Commits that are clean fixes, with their files' findings."""
    return diffs.clean_fixes(diffs.commit_roll_up(diffs.judged_files(files, scans)))


def fix_files(clean: DataFrame) -> DataFrame:
    """(FILE, file_hash, previous_file_hash, V_fixed) of the files of commits."""
    return clean.select(*COMMIT, F.explode("files").alias("_f")).select(*COMMIT, "_f.file_path", "_f.file_hash", "_f.previous_file_hash", "_f.V_fixed")


def templates_of(clean: DataFrame, changes: DataFrame) -> DataFrame:
    """(COMMIT, fixes, template_lines, template_hash) of clean fixes; one without changes has the template of no lines."""
    return _with_sets(clean, clusters.commit_templates(changes.join(clean.select(*COMMIT), COMMIT, "left_semi"), COMMIT).drop("template_hash"))


def templates_of_files(clean: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """``templates_of`` the changes of files (FILE and both hashes) of clean fixes; a pair's lines are made once."""
    lines = by_content(files, FILE, PAIR, lambda rows, by: clusters.commit_templates(_changes(rows, nodes, by), by).drop("template_hash"))
    bags = lines.groupBy(*COMMIT).agg(F.array_sort(F.flatten(F.collect_list("template_lines"))).alias("template_lines"))
    return _with_sets(clean, bags)


def _with_sets(clean: DataFrame, bags: DataFrame) -> DataFrame:
    keys = clean.select(*COMMIT, set_key(F.col("V_fixed_idents")).alias("fixes"))
    met = keys.join(bags, COMMIT, "left").withColumn("template_lines", F.coalesce("template_lines", F.array().cast("array<string>")))
    return met.withColumn("template_hash", clusters.template_digest(F.col("template_lines")))


def pattern_catalog(templates: DataFrame, exemplars: int = 5) -> DataFrame:
    """Rows of the table ``patterns``: sets of fixed rules with their sub-clusters, lines and first commits.

    Sub-clusters and patterns come by falling number of commits, then by hash or name. Clusters are counted before
    they meet, so a pattern's row has one entry for each template, not for each commit.
    """
    found = clusters.cluster(templates, exemplars=exemplars).join(templates.groupBy("fixes", "template_hash").agg(F.min("template_lines").alias("template_lines")), ["fixes", "template_hash"])
    sub = F.struct((-F.col("n_commits")).alias("_order"), "template_hash", "template_lines", "n_commits", "exemplars")
    rows = found.groupBy("fixes").agg(F.sum("n_commits").alias("n_commits"), F.count("*").alias("n_subclusters"), F.sort_array(F.collect_list(sub)).alias("_s"))
    plain = F.transform("_s", lambda s: F.struct(s["template_hash"].alias("template_hash"), s["template_lines"].alias("template_lines"), s["n_commits"].alias("n_commits"), s["exemplars"].alias("exemplars")))
    return rows.select(F.split("fixes", ",").alias("fixes"), "n_commits", "n_subclusters", plain.alias("structural_subclusters")).orderBy(F.col("n_commits").desc(), F.array_join("fixes", ","))


def catalog_keys(patterns: DataFrame) -> DataFrame:
    """(fixes, template_hash) of the catalog's sub-clusters, the set as a key."""
    return patterns.select(set_key(F.col("fixes")).alias("fixes"), F.explode("structural_subclusters.template_hash").alias("template_hash"))


def match_report(matched: DataFrame, examples: int = 3, missed: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of commits with ``outcome``: counts and shares, the first examples of each outcome, the most frequent missed sets."""
    from .reports import shares, top

    first = clusters.first_of_each(matched.select(*COMMIT, "fixes", "outcome"), ["outcome"], COMMIT, examples)
    return shares(matched, "outcome"), first, top(matched.filter("outcome = 'miss'"), ["fixes"], missed)


def classify_hosts(files: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Did the hosts of fixed findings survive? (file kinds, commit kinds) of files (FILE, both hashes, V_fixed).

    A file that fixed nothing, or wasn't scanned, is structural.
    """
    fixed = files.filter(F.size("V_fixed") > 0)
    kinds = by_content(fixed, FILE, [*PAIR, "V_fixed"], lambda rows, by: _host_kinds(rows, nodes, by))
    rest = files.filter(F.coalesce(F.size("V_fixed"), F.lit(-1)) < 1).select(*FILE, F.lit(hosts.STRUCTURAL).alias("kind"), F.lit(0).cast("long").alias("n_findings"), F.lit(0).cast("long").alias("n_survived"))
    by_file = settle(kinds.select(*FILE, "kind", "n_findings", "n_survived").unionByName(rest))
    return by_file, hosts.commit_kind(by_file, COMMIT)


def _host_kinds(fixed: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, n_findings, n_survived) of files that fixed something."""
    depth, seg = F.size("segments"), lambda i: F.try_element_at("segments", F.lit(i))
    under = nodes.filter((depth > 1) & (seg(1) == "jobs"))
    jobs = under.filter(depth == 2).select("file_hash", seg(2).alias("job"), F.col("ordinal").alias("position"))
    step = under.filter((depth == 4) & (seg(3) == "steps"))
    steps = step.select("file_hash", seg(2).alias("job"), F.regexp_extract("route", r"\[(\d+)\]$", 1).cast("int").alias("step"), F.regexp_replace(F.substr(seg(4), F.lit(2)), r"~\d+\]$", "").alias("identity"))
    services = under.filter((depth == 4) & (seg(3) == "services")).select("file_hash", seg(2).alias("job"), seg(4).alias("service"))
    of = lambda rows, c: fixed.select(*keys, F.col(c).alias("file_hash")).join(rows, "file_hash").drop("file_hash")
    findings = fixed.select(*keys, F.explode("V_fixed").alias("_v")).select(*keys, "_v.ident", "_v.route")
    old, new = "previous_file_hash", "file_hash"
    judged = hosts.host_survival(findings, of(steps, old), of(steps, new), of(jobs, old), of(jobs, new), of(services, new), keys)
    return hosts.file_kind(judged, keys)


def export_names(clean: DataFrame) -> DataFrame:
    """(COMMIT, file_path, name): each file's place in the human-readable export."""
    return fix_files(clean).select(*FILE, flat_file_name(F.col("file_path")).alias("name"))


#: Columns of a version: when it was committed, as a time without a zone.
_TIME = lambda c: F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace(c, "T", " "), "(Z|[+]00:00)$", ""))


#: What a walk through a file's history depends on; ``_set`` names the fixed idents.
WALK = ["repository", "branch", "path", "_set"]


def _asked(audits: DataFrame, clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(COMMIT, branch, path, _set) of the files whose history is asked for, and the walks (WALK, V_fixed_idents) for them.

    Commits that fixed the same idents of a file share its walks.
    """
    done = audits.filter((F.col("status") == "ok") & (F.col("verdict") == gaps.FIXED)).select(*COMMIT, "branch")
    targets = clean.select(*COMMIT, "V_fixed_idents", F.explode(F.filter("files", lambda f: F.size(f["V_fixed"]) > 0)).alias("_f"))
    files = done.join(targets.select(*COMMIT, "V_fixed_idents", F.col("_f.file_path").alias("path")), COMMIT).dropDuplicates([*COMMIT, "branch", "path"])
    asked = settle(files.withColumn("_set", F.to_json(F.struct("V_fixed_idents"))))
    return asked.drop("V_fixed_idents"), settle(asked.select(*WALK, "V_fixed_idents").dropDuplicates(WALK))


def _answers(asked: DataFrame, found: DataFrame) -> DataFrame:
    """The walks' answers (WALK, ...) under the files that asked for them."""
    named = found.withColumnsRenamed({c: f"_walk_{c}" for c in WALK})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_walk_{c}")) for c in WALK])
    return asked.join(named, same).select(*COMMIT, "branch", "path", *[c for c in found.columns if c not in WALK])


def _dated(found: DataFrame, commit_info: DataFrame) -> DataFrame:
    fixed = commit_info.select("repository", F.col("commit_sha").alias("commit_hash"), _TIME("committed_at").alias("_fixed_at")).dropDuplicates(COMMIT)
    return history.with_lag(found, fixed, COMMIT, "_fixed_at").drop("_fixed_at")


def branch_histories(audits: DataFrame, clean: DataFrame, file_history: DataFrame, file_at_ref: DataFrame, scans: DataFrame, commit_info: DataFrame, cap: int = history.CAP, deadline: DataFrame | None = None) -> DataFrame:
    """(COMMIT, branch, path, status, ..., refined): when each already fixed branch got the fix, file by file.

    A version counts if it is there and was scanned well; the fix is missing in it while a fixed ident is found.
    ``deadline``: (COMMIT) of records whose time was over; their branches are ``timed_out``. Files without any listed
    version have no scannable history. All versions must lie ready; see ``rounds_of_histories`` for those that don't.
    """
    asked, walks = _asked(audits, clean)
    there = file_at_ref.filter(~F.coalesce("missing", F.lit(False))).select("repository", F.col("ref").alias("commit_sha"), "path", F.col("blob_sha").alias("file_hash"))
    idents = scans.filter("ok").select("file_hash", F.array_distinct(F.transform("findings", lambda f: f["ident"])).alias("_idents"))
    listed = file_history.join(there, ["repository", "commit_sha", "path"], "left").join(idents, "file_hash", "left")
    entity = [*COMMIT, "branch", "path"]
    met = walks.join(listed.select("repository", "branch", "path", "seq", "commit_sha", "committed_at", "_idents"), ["repository", "branch", "path"], "left")
    met = met.withColumns({"_ok": F.col("_idents").isNotNull(), "_hit": F.coalesce(F.arrays_overlap("_idents", "V_fixed_idents"), F.lit(False)), "_at": _TIME("committed_at")})
    found = _answers(asked, history.history_boundary(met, WALK, [F.col("seq").asc_nulls_last()], "commit_sha", "_at", "_ok", "_hit", cap))
    out = _dated(found, commit_info)
    if deadline is not None:
        late = out.join(deadline.select(*COMMIT).distinct().withColumn("_late", F.lit(True)), COMMIT, "left")
        over = lambda c, v: F.when(F.col("_late"), v).otherwise(F.col(c)).alias(c)
        out = late.select(*entity, over("status", F.lit("timed_out")), over("reason", F.lit("timed_out")), over("backport_version", F.lit(None)), over("backported_at", F.lit(None)), "n_read", over("lag_days", F.lit(None)), over("refined", F.lit("timed_out")))
    return out


def rounds_of_histories(
    audits: DataFrame, clean: DataFrame, file_history: DataFrame, commit_info: DataFrame,
    fetch: Callable[[DataFrame], DataFrame], scan: Callable[[DataFrame], DataFrame], step: int = 4, cap: int = history.CAP,
) -> tuple[DataFrame, DataFrame]:
    """(histories, scans made): the answers of ``branch_histories``, with versions fetched and scanned while walking.

    ``n_read`` counts the versions that were read, which end with the first that answers.
    """
    asked, walks = _asked(audits, clean)
    place = F.row_number().over(Window.partitionBy(*WALK).orderBy(F.col("seq").asc_nulls_last(), "commit_sha"))
    versions = walks.drop("V_fixed_idents").join(file_history, ["repository", "branch", "path"])
    listed = settle(versions.select(*WALK, "commit_sha", "committed_at", place.alias("place")))
    walked, scans = history.walk_in_rounds(walks, listed, WALK, fetch, scan, step, cap)
    # versions behind the one that answered weren't read; they tell only that there are more
    met = walks.select(*WALK).join(listed, WALK, "left").join(walked, [*WALK, "place"], "left")
    met = met.withColumns({"_ok": F.coalesce("_ok", F.lit(False)), "_hit": F.coalesce("_hit", F.lit(False)), "_at": _TIME("committed_at")})
    found = _answers(asked, history.history_boundary(met, WALK, [F.col("place").asc_nulls_last()], "commit_sha", "_at", "_ok", "_hit", cap))
    return _dated(found, commit_info), scans


def gap_targets(audits: DataFrame, clean: DataFrame, file_at_ref: DataFrame, scans: DataFrame) -> DataFrame:
    """(COMMIT, branch, path, blob_sha, text, target_idents, program, target) of the files that a gap was found in."""
    targets = clean.select(*COMMIT, F.col("V_fixed_idents").alias("target_idents"), F.explode(F.filter("files", lambda f: F.size(f["V_fixed"]) > 0)).alias("_f"))
    files = targets.select(*COMMIT, "target_idents", F.col("_f.file_path").alias("path"))
    open_branches = audits.filter((F.col("status") == "ok") & (F.col("verdict") == gaps.GAP)).select(*COMMIT, "branch")
    there = file_at_ref.filter(~F.coalesce("missing", F.lit(False))).select("repository", F.col("ref").alias("branch"), "path", "blob_sha", F.decode("content", "UTF-8").alias("text"))
    idents = scans.filter("ok").select(F.col("file_hash").alias("blob_sha"), F.transform("findings", lambda f: f["ident"]).alias("_idents"))
    met = files.join(open_branches, COMMIT).join(there, ["repository", "branch", "path"]).join(idents, "blob_sha").filter(F.arrays_overlap("_idents", "target_idents"))
    named = {"program": F.concat_ws(" ", *COMMIT, "path"), "target": F.concat_ws(" ", *COMMIT, "branch", "path")}
    return met.drop("_idents").withColumns(named)


def patch_run(targets: DataFrame, edits: DataFrame, pins: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, edit outcomes, patched texts) of all targets (program, target, text).

    A target is ``patched``, or has ``no_program``, or its text is missing (``fetch_error``); none is left out.
    """
    from .patches import apply_programs, run_summary

    keys = ["program", "target"]
    known = edits.select("program").distinct().withColumn("_known", F.lit(True))
    asked = settle(targets.select(*keys, "text").join(known, "program", "left"))
    good = asked.filter(F.col("_known") & F.col("text").isNotNull())
    texts = settle(good.select("target", "text").dropDuplicates(["target"]))
    patched, outcomes = apply_programs(edits, good.select(*keys), texts, settle(document_nodes(texts, ["target"])), ["program"], ["target"], pins)
    patched, outcomes = settle(patched.join(texts.select("target", F.col("text").alias("_old")), "target").select(*keys, "patched_text", (F.col("patched_text") != F.col("_old")).alias("text_changed"))), settle(outcomes)
    status = F.when(F.col("_known").isNull(), "no_program").when(F.col("text").isNull(), "fetch_error").otherwise("patched")
    runs = asked.select(*keys, status.alias("status")).join(run_summary(outcomes, keys), keys, "left").join(patched.select(*keys, "text_changed"), keys, "left")
    return runs, outcomes, patched


def judge_run(runs: DataFrame, outcomes: DataFrame, programs: DataFrame, before: DataFrame, after: DataFrame, lint: DataFrame) -> DataFrame:
    """runs with both oracles' answers and the capability bucket.

    programs: (program, target, target_idents); before, after: (program, target, ident, route) of the target's text
    and the patched one; lint: (program, target, kind, message) that only the patched one has.
    """
    from ..functions.columns import scope_of_route
    from .evaluation import verdict
    from .scopes import landed_scopes, local_oracle

    keys = ["program", "target"]
    sites = outcomes.select(*keys, "ordinal", "status", F.explode("site_paths").alias("_site"))
    scopes = landed_scopes(sites, keys, scope_of_route(F.col("_site")))
    return verdict(runs.fillna(0, ["n_needs_review"]), local_oracle(programs, scopes, before, after, keys), lint, keys)
