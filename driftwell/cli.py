"""python -m driftwell.cli COMMAND: the stages, runs and reports as commands over a catalog of tables.

Scanner and linter are programs (``--scanner``, ``--linter``): they read a text on standard input and write JSON.
``--limit`` takes the first commits in the order of their keys; ``stream-all`` reads ``--files`` index files a batch.
"""

from __future__ import annotations

import argparse
import shlex
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .catalog import Catalog
from .functions import patchtext
from .functions.trees import document_nodes
from .operators import chain, clusters, diffs, evaluation, gaps, generators, history, patches, reports, sampling, scopes
from .operators.chain import COMMIT
from .operators.lineage import settle
from .plans import selfcheck as scenarios
from .sources import filetree, scanner, tables
from .streaming.incremental import ask_to_stop, drain, meta_rows, refresh_every, run_available, take_over, watch
from .streaming.memo import ScanMemo

Report = DataFrame | list[DataFrame]


def _limited(rows: DataFrame, a: argparse.Namespace, order: list[str]) -> DataFrame:
    return rows.orderBy(*order).limit(a.limit) if a.limit else rows


def _checker(argv: str | None) -> Callable[[bytes], list[dict]]:
    if not argv:
        raise SystemExit("this command needs --scanner (or --linter): a program that reads a text and writes JSON")
    return scanner.command(shlex.split(argv))


def _scan(cat: Catalog, hashes: DataFrame, a: argparse.Namespace) -> DataFrame:
    """Scans of blobs, those not yet scanned well with the scanner; left as they are if none is given."""
    known = cat.read("scans")
    if not a.scanner:
        return known
    new = scanner.scan(cat.read("blobs").join(hashes.distinct(), "file_hash", "left_semi"), _checker(a.scanner), known)
    return tables.merge_scans(known, new)


def sample(cat: Catalog, a: argparse.Namespace) -> Report:
    rows = sampling.sample_commits(tables.read_index(cat.spark, a.index), a.n, a.seed)
    cat.replace("sampled_commits", rows)
    return cat.read("sampled_commits").agg(F.count("*").alias("n_commits"))


def _files(cat: Catalog) -> DataFrame:
    return sampling.file_diffs(cat.read("sampled_commits")).drop("committed_date")


def make_diffs(cat: Catalog, a: argparse.Namespace) -> Report:
    files = settle(_files(cat))
    texts = tables.blob_texts(cat.read("blobs").join(sampling.distinct_blobs(files), "file_hash", "left_semi"))
    nodes = chain.parsed(texts)
    cat.replace("diffs", chain.usable_diffs(chain.diff_rows(files, nodes)))
    return cat.read("diffs").agg(F.count("*").alias("n_file_diffs"), F.countDistinct(*COMMIT).alias("n_commits"))


def scan(cat: Catalog, a: argparse.Namespace) -> Report:
    cat.replace("scans", settle(_scan(cat, sampling.distinct_blobs(_files(cat)), a)))
    return cat.read("scans").groupBy("ok").agg(F.count("*").alias("n"))


def clean_fixes(cat: Catalog, a: argparse.Namespace) -> Report:
    """Of file-diffs that could be read and aren't empty, if the diffs were made; else of all."""
    files, made = _files(cat), cat.read("diffs").select(*chain.FILE).distinct()
    files = files.join(made, chain.FILE, "left_semi") if made.limit(1).count() else files
    clean = settle(chain.clean_commits(files, cat.read("scans")))
    cat.replace("clean_fix_meta", meta_rows(clean))
    folder = F.concat_ws("__", F.replace("repository", F.lit("/"), F.lit("__")), F.substring("commit_hash", 1, 10))
    cat.replace("clean_fix_index", cat.read("clean_fix_meta").select(folder.alias("dir"), *COMMIT, "V_fixed_count", "V_fixed_idents", "n_files_modified").orderBy(F.col("V_fixed_count").desc(), *COMMIT))
    cat.replace("export", tables.commit_export(clean, tables.blob_texts(cat.read("blobs"))))
    if a.out:  # folders of commits, each with its meta and both versions of its files
        filetree.write_tree(cat.read("export").unionByName(filetree.meta_files(cat.read("clean_fix_meta"))), a.out)
    return cat.read("clean_fix_meta").agg(F.count("*").alias("n_clean"))


def _meta_files(cat: Catalog) -> DataFrame:
    """(FILE, both hashes, V_fixed) of the catalog's clean fixes."""
    return _files_of(cat.read("clean_fix_meta"))


def _files_of(clean: DataFrame) -> DataFrame:
    files = clean.select(*COMMIT, F.explode("files").alias("f"))
    return files.select(*COMMIT, "f.file_path", F.col("f.after").alias("file_hash"), F.col("f.before").alias("previous_file_hash"), "f.V_fixed")


def _templates(cat: Catalog, clean: DataFrame | None = None) -> DataFrame:
    clean = settle(cat.read("clean_fix_meta") if clean is None else clean)
    files = settle(_files_of(clean))
    nodes = chain.parsed(tables.blob_texts(cat.read("blobs").join(sampling.distinct_blobs(files), "file_hash", "left_semi")))
    return settle(chain.templates_of_files(clean, files, nodes))


def patterns(cat: Catalog, a: argparse.Namespace) -> Report:
    """Sets of fixed rules with their templates, and their distribution."""
    cat.replace("patterns", chain.pattern_catalog(_templates(cat)))
    rows = cat.read("patterns").select(F.array_join("fixes", ",").alias("fixes"), "n_commits", "n_subclusters")
    return [reports.ranked(rows, "n_commits", ["fixes"], a.top), reports.catalog_distribution(rows)]


def match(cat: Catalog, a: argparse.Namespace) -> Report:
    """Clean fixes of another tag against this tag's patterns."""
    other = Catalog(cat.spark, cat.root, a.new)
    matched = settle(clusters.match_catalog(_templates(other), chain.catalog_keys(cat.read("patterns"))))
    return list(chain.match_report(matched))


def pipeline(cat: Catalog, a: argparse.Namespace) -> Report:
    out: list[DataFrame] = []
    for stage in (sample, make_diffs, scan, clean_fixes, patterns):
        got = stage(cat, a)
        out += got if isinstance(got, list) else [got]
    return out


def classify(cat: Catalog, a: argparse.Namespace) -> Report:
    files = settle(_files_of(_limited(cat.read("clean_fix_meta"), a, COMMIT)))
    nodes = chain.parsed(tables.blob_texts(cat.read("blobs").join(sampling.distinct_blobs(files), "file_hash", "left_semi")))
    _, kinds = chain.classify_hosts(files, nodes)
    cat.replace("classification", kinds.select(*COMMIT, "kind", F.concat_ws("__", F.replace("repository", F.lit("/"), F.lit("__")), F.substring("commit_hash", 1, 10)).alias("dir")))
    return gaps.kind_counts(cat.read("classification"))


def refilter(cat: Catalog, a: argparse.Namespace) -> Report:
    """Gap rates and back-ports, of all clean fixes and of structural ones alone."""
    kinds, walked = cat.read("classification"), _branches(cat)
    status = reports.shares(gaps.structural_only(walked, kinds), "refined")
    return [gaps.refilter_headline(cat.read("gaps"), kinds), reports.shares(walked, "refined"), status]


def find_gaps(cat: Catalog, a: argparse.Namespace) -> Report:
    read = cat.read
    heads = read("file_at_ref").filter("content is not null")
    scans = read("scans")
    if a.scanner:
        blobs = heads.select(F.col("blob_sha").alias("file_hash"), "content").dropDuplicates(["file_hash"])
        cat.replace("scans", settle(tables.merge_scans(scans, scanner.scan(blobs, _checker(a.scanner), scans))))
        scans = read("scans")
    found = gaps.audit(_limited(read("clean_fix_meta"), a, COMMIT), read("repos"), read("branches"), read("commit_on_branch"), read("file_at_ref"), scans)
    cat.replace("gaps", found.select("repository", "commit_hash", "branch", "default_branch", "status", "V_fixed_idents", "verdict", "n_scan_failed", "idents_present"))
    return gaps.headline(read("gaps").filter("verdict is not null"))


def gaps_summary(cat: Catalog, a: argparse.Namespace) -> Report:
    return list(gaps.audit_summary(cat.read("gaps")))


def classify_history(cat: Catalog, a: argparse.Namespace) -> Report:
    read = cat.read
    cat.replace("history", chain.branch_histories(read("gaps"), _limited(read("clean_fix_meta"), a, COMMIT), read("file_history"), read("file_at_ref"), read("scans"), read("commit_info"), a.cap))
    return reports.shares(read("history"), "refined")


def _branches(cat: Catalog) -> DataFrame:
    """Histories rolled up to branches, with the refined status."""
    from .functions.columns import refined_status

    rolled = history.branch_roll_up(cat.read("history"), [*COMMIT, "branch"])
    late = cat.read("history").filter("status = 'timed_out'").select(*COMMIT, "branch").distinct().withColumn("_late", F.lit(True))
    met = rolled.join(late, [*COMMIT, "branch"], "left").withColumn("refined", F.when(F.col("_late"), "timed_out").otherwise(refined_status(F.col("status"), F.col("lag_days"))))
    return met.drop("_late").join(cat.read("clean_fix_meta").select(*COMMIT, "V_fixed_idents"), COMMIT, "left")


def history_summary(cat: Catalog, a: argparse.Namespace) -> Report:
    branches = settle(_branches(cat))
    status, by_ident = history.history_summary(branches)
    late = branches.filter("refined = 'true_backport'")
    files = cat.read("history").join(branches.filter("refined = 'inconclusive'").select(*COMMIT, "branch"), [*COMMIT, "branch"], "left_semi")
    reasons = history.inconclusive_reasons(files, [*COMMIT, "branch"], "path").groupBy("reason").agg(F.count("*").alias("n"))
    places = history.percentiles(late, "lag_days", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9})
    return [status, reasons, history.lag_summary(late), places, history.lag_histogram(late), by_ident, history.true_backports(branches, [*COMMIT, "branch"]).drop("V_fixed_idents"), history.lag_cluster(branches)]


def compare_filters(cat: Catalog, a: argparse.Namespace) -> Report:
    """How many commits each of the clean-fix predicates takes."""
    judged = settle(diffs.file_findings(diffs.join_scans(_files(cat), cat.read("scans"))))
    side = lambda c, name: judged.select(*COMMIT, F.explode(c).alias("_f")).select(*COMMIT, "_f.ident", F.lit(name).alias("side"))
    found = diffs.fix_variants(side("V_fixed", "fixed").unionAll(side("V_introduced", "introduced")), COMMIT)
    return found.agg(*[F.count_if(c).alias(c) for c in ("strict", "loose_a", "loose_b", "loose_c")])


def drill_gaps(cat: Catalog, a: argparse.Namespace) -> Report:
    """Where the gaps are: the headline, then repositories, branches and rules with most of them."""
    audits = settle(cat.read("gaps"))
    open_ = settle(audits.filter(F.col("verdict") == gaps.GAP))
    repositories = open_.groupBy("repository").agg(F.count("*").alias("n_gaps"), F.countDistinct("commit_hash").alias("n_commits"))
    branches = open_.groupBy("branch").agg(F.count("*").alias("n_gaps"))
    rules = open_.select(F.explode(F.array_distinct("idents_present")).alias("ident")).groupBy("ident").agg(F.count("*").alias("n_gaps"))
    return [gaps.headline(audits), *[reports.ranked(rows, "n_gaps", [key], a.top) for rows, key in ((repositories, "repository"), (branches, "branch"), (rules, "ident"))]]


def cross_rules(cat: Catalog, a: argparse.Namespace) -> Report:
    """Rules against what became of them: commits that fix them, pairs fixed together, statuses of back-ports, rates of gaps."""
    fixed = settle(cat.read("clean_fix_meta").select(*COMMIT, F.explode(F.array_distinct("V_fixed_idents")).alias("ident")))
    of = lambda verdict, idents: cat.read("gaps").filter(F.col("verdict") == verdict).select(F.explode(F.array_distinct(idents)).alias("ident"))
    by_status = _branches(cat).select(F.explode(F.array_distinct("V_fixed_idents")).alias("ident"), "refined")
    return [
        reports.ranked(fixed.groupBy("ident").agg(F.count("*").alias("n_commits")), "n_commits", ["ident"], a.top),
        reports.ranked(reports.co_occurrence(fixed, COMMIT, "ident"), "n", ["a", "b"], a.top),
        reports.cross_tab(by_status, "ident", "refined", ["true_backport", "same_day_fix", "independent_prior_fix"]).orderBy("ident"),
        reports.gap_rate(of(gaps.GAP, "idents_present"), of(gaps.FIXED, "V_fixed_idents"), "ident").orderBy("ident"),
    ]


def stream_all(cat: Catalog, a: argparse.Namespace) -> Report:
    """Take up the index's new files batch by batch.

    It says how far it is after each batch, lets a batch end at the first interrupt and stops, and replaces the pattern
    catalog every ``--refresh`` minutes and at the end.
    """
    check, blobs = _checker(a.scanner), cat.read("blobs").unionByName(cat.read("file_at_ref").filter("content is not null").select(F.col("blob_sha").alias("file_hash"), "content"))
    asked = lambda hashes: blobs.join(hashes, "file_hash", "left_semi").dropDuplicates(["file_hash"])
    memo = ScanMemo(cat.spark, f"{cat.path('stream')}/memo", check)
    renew = lambda: cat.replace("patterns", chain.pattern_catalog(_templates(cat, cat.log("clean_fix_meta"))))
    stop, clock = threading.Event(), refresh_every(cat.spark, renew, f"{a.refresh} minutes") if a.refresh else None
    undo = ask_to_stop(stop) if threading.current_thread() is threading.main_thread() else lambda: None
    try:
        run_available(cat.spark, a.index, cat, lambda h: memo.ask(asked(h)), lambda h: tables.blob_texts(asked(h)), f"{cat.path('stream')}/state", a.files, started=lambda q: watch(q, lambda line: print(line, flush=True)), stop=stop)
    finally:
        undo()
        if clock is not None:
            drain(clock)
    renew()
    cat.compact()
    return reports.shares(cat.log("outcomes"), "outcome")


def import_tag(cat: Catalog, a: argparse.Namespace) -> Report:
    """Begin with what the tag --new has done."""
    take_over(cat, Catalog(cat.spark, cat.root, a.new))
    return reports.shares(cat.log("outcomes"), "outcome")


def compile_programs(cat: Catalog, a: argparse.Namespace) -> Report:
    texts = tables.blob_texts(cat.read("blobs"))
    files = _limited(cat.read("clean_fix_meta"), a, COMMIT).select("repository", "commit_hash", "V_fixed_idents", F.explode("files").alias("f")).filter(F.size("f.V_fixed") > 0)
    named = files.withColumn("program", F.concat_ws(" ", "repository", "commit_hash", "f.file_path"))
    side = lambda c: named.select("program", F.col(c).alias("file_hash")).join(texts, "file_hash")
    edits = patches.compile_edits(document_nodes(side("f.before"), ["program"]), document_nodes(side("f.after"), ["program"]), ["program"])
    cat.replace("edits", edits)
    if a.out:
        heads = named.select("program", "repository", "commit_hash", F.col("f.file_path").alias("source_file"), F.col("V_fixed_idents").alias("target_idents"))
        patchtext.render(heads, cat.read("edits")).write.mode("overwrite").parquet(a.out)
    return [cat.read("edits").groupBy("op").agg(F.count("*").alias("n"), F.count("review").alias("n_review")), evaluation.compile_counters(cat.read("edits"))]


def _findings(cat: Catalog, texts: DataFrame, a: argparse.Namespace) -> DataFrame:
    """(program, target, ident, route) that the scanner finds in texts (program, target, text)."""
    blobs = texts.select(F.sha2("text", 256).alias("file_hash"), F.encode("text", "UTF-8").alias("content"))
    found = scanner.scan(blobs, _checker(a.scanner)).filter("ok")
    return texts.select("program", "target", F.sha2("text", 256).alias("file_hash")).join(found, "file_hash").select("program", "target", F.explode("findings").alias("_f")).select("program", "target", "_f.ident", "_f.route")


def _faults(texts: DataFrame, a: argparse.Namespace) -> DataFrame:
    """(program, target, kind, message) of the linter, or none without one: its ident is the kind, its route the message."""
    if not a.linter:
        return texts.select("program", "target", F.lit("").alias("kind"), F.lit("").alias("message")).limit(0)
    blobs = texts.select(F.sha2("text", 256).alias("file_hash"), F.encode("text", "UTF-8").alias("content"))
    found = scanner.scan(blobs, _checker(a.linter)).filter("ok")
    met = texts.select("program", "target", F.sha2("text", 256).alias("file_hash")).join(found, "file_hash")
    return scopes.lint_keys(met.select("program", "target", F.transform("findings", lambda f: F.struct(f["ident"].alias("kind"), f["route"].alias("message"))).alias("faults")), ["program", "target"])


def backport(cat: Catalog, a: argparse.Namespace) -> Report:
    """Programs on all targets with a gap; with --scanner both oracles judge them."""
    read, keys = cat.read, ["program", "target"]
    targets = settle(_limited(chain.gap_targets(read("gaps"), read("clean_fix_meta"), read("file_at_ref"), read("scans")), a, keys))
    runs, outcomes, patched = chain.patch_run(targets, read("edits"), read("ref_resolution").select("action", "ref", "sha"))
    cat.replace("patches", patched)
    cat.replace("edit_outcomes", outcomes)
    if not a.scanner:
        return reports.shares(runs, "status")
    old, new = settle(targets.select(*keys, "text")), settle(patched.select(*keys, F.col("patched_text").alias("text")))
    lint = scopes.lint_introduced(_faults(old, a), _faults(new, a), keys)
    judged = chain.judge_run(runs, outcomes, targets.select(*keys, "target_idents"), _findings(cat, old, a), _findings(cat, new, a), lint)
    cat.replace("patch_runs", judged)
    return capability(cat, a)


def capability(cat: Catalog, a: argparse.Namespace) -> Report:
    """Buckets of the patched targets, and acceptance by rule."""
    runs = cat.read("patch_runs")
    idents = cat.read("clean_fix_meta").select(F.concat_ws(" ", *COMMIT).alias("_c"), F.col("V_fixed_idents").alias("target_idents"))
    ruled = runs.withColumn("_c", F.array_join(F.slice(F.split("program", " "), 1, 2), " ")).join(idents, "_c")
    return [reports.shares(runs, "bucket"), reports.acceptance_by_rule(ruled)]


def _program_of(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"program": F.concat_ws(" ", *COMMIT, "path"), "target": F.concat_ws(" ", *COMMIT, "branch", "path")})


def reproduce(cat: Catalog, a: argparse.Namespace) -> Report:
    """Programs on the parents of human back-ports, and how near the patched texts come to what people committed."""
    read, keys = cat.read, ["program", "target"]
    cases = settle(_limited(_program_of(evaluation.backport_cases(read("history"), read("commit_info"), read("file_at_ref"))), a, keys))
    _, _, patched = chain.patch_run(cases.select(*keys, F.col("parent_text").alias("text")), read("edits"), read("ref_resolution").select("action", "ref", "sha"))
    rows = cases.join(patched.select(*keys, "patched_text"), keys, "left")
    effect = F.lit(None).cast("boolean").alias("effect")
    if a.scanner:
        both = settle(rows.filter("patched_text is not null and human_text is not null"))
        ours, theirs = (_findings(cat, both.select(*keys, F.col(c).alias("text")), a) for c in ("patched_text", "human_text"))
        same = evaluation.same_effect(ours, theirs, keys)
        # Two texts without any findings leave the same ones as well.
        rows = rows.join(same, keys, "left").join(both.select(*keys, F.lit(True).alias("_both")), keys, "left").withColumn("effect", F.coalesce("effect", "_both")).drop("_both")
    else:
        rows = rows.select("*", effect)
    compared = settle(evaluation.compare_with_human(rows, keys))
    cat.replace("cases", evaluation.case_files(compared, keys))
    return [reports.reproduction(compared), reports.shares(compared, "outcome")]


def compare_generators(cat: Catalog, a: argparse.Namespace) -> Report:
    """The patch engine beside the other generators, on the targets of ``backport``."""
    read, keys = cat.read, ["program", "target"]
    targets = settle(_limited(chain.gap_targets(read("gaps"), read("clean_fix_meta"), read("file_at_ref"), read("scans")), a, keys))
    texts = tables.blob_texts(read("blobs"))
    side = lambda c, name: _meta_files(cat).select(F.concat_ws(" ", *COMMIT, "file_path").alias("program"), F.col(c).alias("file_hash")).join(texts, "file_hash").select("program", F.col("text").alias(name))
    rows = settle(targets.select(*keys, "target_idents", F.col("text").alias("_text")).join(side("previous_file_hash", "before"), "program").join(side("file_hash", "after"), "program"))
    made = settle(generators.outputs(rows.select(*keys, "before", "after", F.col("_text").alias("target_text")).withColumnRenamed("target", "target_name").withColumnRenamed("target_text", "target"), ["program", "target_name"], read("patches").select("program", F.col("target").alias("target_name"), "patched_text")))
    named = made.select("program", F.concat_ws("\t", "target_name", "generator").alias("target"), F.col("target_name").alias("_name"), "generator", "output")
    old = settle(named.join(rows.select("program", F.col("target").alias("_name"), "_text"), ["program", "_name"]).select(*keys, F.col("_text").alias("text")))
    new = settle(named.filter("output is not null").select(*keys, F.col("output").alias("text")))
    programs = named.join(rows.select("program", F.col("target").alias("_name"), "target_idents"), ["program", "_name"]).select(*keys, "target_idents")
    judged = scopes.global_oracle(programs, _findings(cat, old, a), _findings(cat, new, a), keys)
    faults = scopes.lint_introduced(_faults(old, a), _faults(new, a), keys).select(*keys).distinct().withColumn("_fault", F.lit(True))
    met = named.join(judged, keys, "left").join(faults, keys, "left")
    rated = evaluation.generator_outcome(met.select("generator", "output", F.lit("ok").alias("oracle_status"), F.coalesce("success", F.lit(False)).alias("oracle_ok"), F.col("_fault").isNull().alias("lint_ok")))
    return reports.generator_counts(rated.select(F.create_map("generator", "outcome").alias("outcomes")))


def apply_one(cat: Catalog, a: argparse.Namespace) -> Report:
    """A program's text on one file: the outcomes, and the patched text to --out."""
    text = cat.spark.read.text(a.program, wholetext=True).select(F.lit("p").alias("program"), F.col("value").alias("text"))
    _, edits = patchtext.read(text)
    target = cat.spark.read.text(a.target, wholetext=True).select(F.lit("p").alias("program"), F.lit("t").alias("target"), F.col("value").alias("text"))
    runs, outcomes, patched = chain.patch_run(target, edits, cat.read("ref_resolution").select("action", "ref", "sha"))
    if a.out:
        patched.select(F.regexp_replace("patched_text", r"\n$", "")).coalesce(1).write.mode("overwrite").text(a.out)
    return [runs.drop("program", "target"), outcomes.drop("program", "target").orderBy("ordinal")]


def oracle(cat: Catalog, a: argparse.Namespace) -> Report:
    """Both oracles on one patched file: --target before, --out after, --idents that it should fix."""
    read = lambda path: cat.spark.read.text(path, wholetext=True).select(F.lit("p").alias("program"), F.lit("t").alias("target"), F.col("value").alias("text"))
    before, after = settle(read(a.target)), settle(read(a.out))
    program = before.select("program", "target", F.split(F.lit(a.idents), ",").alias("target_idents"))
    b, f, keys = _findings(cat, before, a), _findings(cat, after, a), ["program", "target"]
    lint = scopes.lint_introduced(_faults(before, a), _faults(after, a), keys)
    return [scopes.global_oracle(program, b, f, keys), scopes.target_sets(program, b, f, keys), lint.drop(*keys)]


def self_check(cat: Catalog, a: argparse.Namespace) -> Report:
    return scenarios.run(cat.spark)


COMMANDS = {
    "sample": sample, "diffs": make_diffs, "scan": scan, "clean-fixes": clean_fixes, "patterns": patterns, "match": match, "pipeline": pipeline,
    "classify": classify, "refilter": refilter, "find-gaps": find_gaps, "gaps-summary": gaps_summary, "classify-history": classify_history,
    "history-summary": history_summary, "compare-filters": compare_filters, "drill-gaps": drill_gaps, "cross-rules": cross_rules, "stream-all": stream_all, "import": import_tag, "compile": compile_programs, "backport": backport, "capability": capability, "reproduce": reproduce, "compare-generators": compare_generators,
    "apply": apply_one, "oracle": oracle, "selfcheck": self_check,
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--root", required=True)
    p.add_argument("--tag", default="default")
    for name in ("index", "new", "out", "scanner", "linter", "program", "target", "idents"):
        p.add_argument(f"--{name}")
    for name, value in (("n", 10_000), ("seed", 42), ("top", 10), ("limit", 0), ("cap", history.CAP), ("files", 1000), ("refresh", 30)):
        p.add_argument(f"--{name}", type=int, default=value)
    a = p.parse_args(argv)
    cat = Catalog(spark or SparkSession.builder.appName("driftwell").getOrCreate(), a.root, a.tag)
    got = COMMANDS[a.command](cat, a)
    text = "\n".join(reports.markdown(t) for t in (got if isinstance(got, list) else [got]))
    print(text)
    return text


if __name__ == "__main__":
    main()
