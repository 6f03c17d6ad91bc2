"""Whole runs over the world of repositories: catalog, audit, histories, patches and the incremental driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import Catalog
from ..functions.columns import refined_status
from ..functions.trees import document_nodes
from ..operators import chain, clusters, diffs, evaluation, gaps, generators, history, patches, reports, sampling
from ..operators.lineage import settle, shared_folder
from ..sources import scanner, tables as files_of
from ..streaming.incremental import run_available
from . import world
from .analytics import _nested
from .tables import table

Q: dict = {}
SQL: dict[str, str] = {}
CTE = f"WITH {world.FILES.strip()}"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _number(c: str = "commit_hash") -> F.Column:
    return F.substring(c, 2, 20).cast("long")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.valid_modifications(world.index(spark, sf_dir))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.clean_commits(_files(spark, sf_dir), world.scans(spark))


def _nodes(spark: SparkSession) -> DataFrame:
    return chain.parsed(world.blobs(spark).select("file_hash", "text"))


@query(CTE + " SELECT o, count(*) AS n_files, min(strftime(d, '%Y-%m-%dT%H:%M:%SZ')) AS committed_date, string_agg(file || ':b' || k || ':a' || k, ',' ORDER BY file) AS files FROM f GROUP BY o")
def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written as CSV with a header and read back with its schema, filtered and rolled up."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    world.index(spark, sf_dir).write.option("header", True).csv(folder)
    parts = [F.col(c) for c in ("file_path", "file_hash", "previous_file_hash")]
    commits = sampling.roll_up(sampling.valid_modifications(files_of.read_index(spark, folder)), chain.COMMIT, "committed_date", parts)
    names = F.transform("files", lambda x: F.concat_ws(":", x["file_path"], x["previous_file_hash"], x["file_hash"]))
    return commits.select(_number().alias("o"), F.size("files").cast("long").alias("n_files"), "committed_date", F.array_join(names, ",").alias("files"))


@query("SELECT k::BIGINT AS k, side || k AS file_hash, side = 'b' OR k <> 40 AS ok, CASE WHEN side = 'b' THEN 'perm,pin' WHEN k = 40 THEN NULL ELSE concat_ws(',', CASE WHEN k % 6 = 4 AND floor(k / 6) % 2 = 1 THEN 'dbg' END, CASE WHEN k % 6 IN (1, 3, 4) THEN 'perm' END, CASE WHEN k % 6 IN (0, 4) THEN 'pin' END) END AS idents FROM range(42) r(k), (SELECT unnest(['b', 'a']) AS side)")
def scanner_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct blob scanned once, though all commits name them."""
    asked = sampling.distinct_blobs(_files(spark, sf_dir))
    found = scanner.scan(world.blobs(spark).select("file_hash", "content").join(asked, "file_hash", "right"), world.check)
    return scanner.ident_sets(found).join(found.select("file_hash", "ok"), "file_hash").select(_number("file_hash").alias("k"), "file_hash", "ok", F.array_join("idents", ",").alias("idents"))


@query(CTE + f", {world.CHANGES.strip()} SELECT path, change, old, new, count(*) AS n FROM ch GROUP BY ALL")
def document_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chain.document_changes(_files(spark, sf_dir), _nodes(spark))
    return found.groupBy("path", "change", "old", "new").agg(F.count("*").alias("n"))


@query(CTE + """
, s AS (SELECT *, CASE WHEN t IN (0, 1) THEN 0 WHEN t = 2 THEN 3 WHEN k = 40 THEN 0 WHEN t IN (3, 5) THEN 2 ELSE 1 END AS a,
               CASE WHEN k = 40 THEN 4 WHEN t IN (2, 3, 5) THEN 3 ELSE 0 END AS r, CASE WHEN t IN (0, 1, 2, 5) THEN 1 ELSE 0 END AS c FROM f)
SELECT k::BIGINT AS k, a::BIGINT AS n_added, r::BIGINT AS n_removed, c::BIGINT AS n_changed, count(*) AS n FROM s GROUP BY ALL""")
def diff_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the table of diffs; one version that can't be read gives removals, and none is left out."""
    files, nodes = _files(spark, sf_dir), _nodes(spark)
    rows = chain.usable_diffs(chain.diff_rows(files, nodes))
    sizes = [F.size(c).cast("long").alias(f"n_{c}") for c in ("added", "removed", "changed")]
    return rows.select(_number("file_hash").alias("k"), *sizes).groupBy("k", "n_added", "n_removed", "n_changed").agg(F.count("*").alias("n"))


_SKETCH = "CASE WHEN {c} IN ('write-all', 'read-all') THEN 'perm:' || {c} WHEN {c} LIKE 'acme/fetch@v%' THEN 'uses:acme/fetch@<tag>' WHEN {c} LIKE 'acme/fetch@1%' THEN 'uses:acme/fetch@<sha>' WHEN {c} = 'True' THEN 'bool:True' ELSE 'str' END"
LINES = f"""
, {world.CHANGES.strip()},
li AS (
  SELECT o, CASE change WHEN 'added' THEN '+ ' || p || ' = ' || sn WHEN 'removed' THEN '- ' || p || ' = ' || so ELSE '~ ' || p || ' : ' || so || ' -> ' || sn END AS line
  FROM (SELECT o, change, {_nested('path')} AS p, {_SKETCH.format(c='old')} AS so, {_SKETCH.format(c='new')} AS sn FROM ch)),
te AS (SELECT o, string_agg(line, chr(10) ORDER BY line) || chr(10) AS body FROM li GROUP BY o),
ct AS (SELECT clean.o, clean.fixes, sha256(body) AS template_hash, body FROM clean JOIN te USING (o))
"""


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = settle(_clean(spark, sf_dir))
    return settle(chain.templates_of_files(clean, chain.fix_files(clean), _nodes(spark)))


@query(CTE + LINES + """
SELECT fixes, (SELECT count(*) FROM ct x WHERE x.fixes = ct.fixes) AS n_of_set, template_hash, any_value(rtrim(body, chr(10))) AS lines, count(*) AS n_commits, min('r' || n || ' c' || o) AS first_commit
FROM ct JOIN (SELECT o, n FROM clean) USING (o) GROUP BY fixes, template_hash""")
def pattern_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From commits to patterns: sets of fixed rules, sub-clusters by template, lines and first commits."""
    rows = chain.pattern_catalog(_templates(spark, sf_dir)).select(F.array_join("fixes", ",").alias("fixes"), F.col("n_commits").alias("n_of_set"), F.explode("structural_subclusters").alias("s"))
    first = F.concat_ws(" ", F.col("s.exemplars")[0]["repository"], F.col("s.exemplars")[0]["commit_hash"])
    return rows.select("fixes", "n_of_set", "s.template_hash", F.array_join("s.template_lines", "\n").alias("lines"), "s.n_commits", first.alias("first_commit"))


@query(CTE + LINES + """
, m AS (SELECT CASE WHEN (fixes, template_hash) IN (SELECT (fixes, template_hash) FROM ct WHERE o % 4 <> 1 AND fixes <> 'perm,pin') THEN 'full'
                    WHEN fixes IN (SELECT fixes FROM ct WHERE o % 4 <> 1 AND fixes <> 'perm,pin') THEN 'level-1' ELSE 'miss' END AS outcome, fixes FROM ct)
SELECT 'outcome' AS part, outcome AS name, count(*) AS n FROM m GROUP BY outcome
UNION ALL SELECT 'example', outcome, least(count(*), 3) FROM m GROUP BY outcome
UNION ALL SELECT 'missed', fixes, count(*) FROM m WHERE outcome = 'miss' GROUP BY fixes""")
def match_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All commits against a catalog of three in four of them, without those that fix both rules."""
    templates = _templates(spark, sf_dir)
    catalog = chain.catalog_keys(chain.pattern_catalog(templates.filter((_number() % 4 != 1) & (F.col("fixes") != "perm,pin"))))
    counts, examples, missed = chain.match_report(settle(clusters.match_catalog(templates, catalog)))
    part = lambda rows, part, name: rows.select(F.lit(part).alias("part"), F.col(name).alias("name"), "n")
    return part(counts, "outcome", "outcome").unionAll(part(examples.groupBy("outcome").agg(F.count("*").alias("n")), "example", "outcome")).unionAll(part(missed, "missed", "fixes"))


@query(CTE + """
SELECT o, kind, n_deleted FROM (SELECT o, kind FROM clean) JOIN (
  SELECT o, count(*) FILTER (t = 3) AS n_deleted FROM f GROUP BY o) USING (o)""")
def host_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fixes kept their hosts: from documents and findings to kinds of files and commits."""
    by_file, commits = chain.classify_hosts(chain.fix_files(settle(_clean(spark, sf_dir))), _nodes(spark))
    deleted = by_file.groupBy(*chain.COMMIT).agg(F.count_if(F.col("kind") == "deletion").alias("n_deleted"))
    return commits.join(deleted, chain.COMMIT).select(_number().alias("o"), "kind", "n_deleted")


@query(CTE + " SELECT kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM clean GROUP BY kind")
def kind_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, commits = chain.classify_hosts(chain.fix_files(settle(_clean(spark, sf_dir))), _nodes(spark))
    return gaps.kind_counts(commits)


def _audits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    clean, forge = settle(_clean(spark, sf_dir)), world.forge(spark, sf_dir)
    found = gaps.audit(clean, forge["repos"], forge["branches"], forge["commit_on_branch"], forge["file_at_ref"], world.scans(spark))
    return settle(found), clean, forge


@query(CTE + f", {world.AUDITS.strip()}" + """
SELECT clean.o, clean.status, au.branch, au.verdict, coalesce(au.n_scan_failed, 0)::BIGINT AS n_scan_failed, au.idents, clean.fixes FROM clean LEFT JOIN au ON au.o = clean.o""")
def full_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, _ = _audits(spark, sf_dir)
    return found.select(_number().alias("o"), "status", "branch", "verdict", F.coalesce("n_scan_failed", F.lit(0)).cast("long").alias("n_scan_failed"), F.array_join("idents_present", ",").alias("idents"), F.array_join("V_fixed_idents", ",").alias("fixes"))


@query(CTE + f", {world.AUDITS.strip()}" + """
, g AS (SELECT o, count(*) FILTER (verdict = 'gap') AS n_gap FROM au GROUP BY o)
SELECT 'status' AS part, status AS name, count(*) AS n FROM clean GROUP BY status
UNION ALL SELECT 'total', u.p, u.n FROM (SELECT unnest([{'p': 'n_ok', 'n': count(*)}, {'p': 'n_with_gap', 'n': count(*) FILTER (n_gap > 0)}]) AS u FROM g)
UNION ALL SELECT 'total', 'n_branches', count(*) FROM au UNION ALL SELECT 'total', 'n_gap', count(*) FROM au WHERE verdict = 'gap'
UNION ALL SELECT 'total', 'n_fixed', count(*) FROM au WHERE verdict = 'already_fixed' UNION ALL SELECT 'total', 'n_inapplicable', count(*) FROM au WHERE verdict = 'inapplicable'
UNION ALL SELECT 'gaps', n_gap::VARCHAR, count(*) FROM g GROUP BY n_gap
UNION ALL SELECT 'ident', ident, count(*) FROM (SELECT unnest(string_split(idents, ',')) AS ident FROM au WHERE verdict = 'gap') GROUP BY ident""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, totals, by_gaps, idents = gaps.audit_summary(_audits(spark, sf_dir)[0])
    part = lambda rows, part, name: rows.select(F.lit(part).alias("part"), F.col(name).cast("string").alias("name"), F.col("n").cast("long").alias("n"))
    sums = totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in totals.columns])).alias("_t")).select("_t.*")
    return part(status, "status", "status").unionAll(part(sums, "total", "name")).unionAll(part(by_gaps, "gaps", "n_gap")).unionAll(part(idents, "ident", "ident"))


_HEAD = """SELECT '{0}' AS scope, count(DISTINCT n) AS n_repos, count(DISTINCT n) FILTER (verdict = 'gap') AS n_repos_with_gap, count(DISTINCT o) AS n_commits, count(DISTINCT o) FILTER (verdict = 'gap') AS n_commits_with_gap,
  count(*) AS n_branches, count(*) FILTER (verdict = 'gap') AS n_gap, count(*) FILTER (verdict = 'already_fixed') AS n_fixed, count(*) FILTER (verdict = 'inapplicable') AS n_inapplicable,
  round(count(*) FILTER (verdict = 'gap') / count(*), 6) AS gap_rate, round(count(*) FILTER (verdict = 'gap') / nullif(count(*) FILTER (verdict <> 'inapplicable'), 0), 6) AS actionable_rate FROM au{1}"""


@query(CTE + f", {world.AUDITS.strip()} " + _HEAD.format("all", "") + " UNION ALL " + _HEAD.format("structural", " WHERE kind = 'structural'"))
def refilter_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline of all clean fixes, and of those whose hosts survived."""
    audits, clean, _ = _audits(spark, sf_dir)
    _, kinds = chain.classify_hosts(chain.fix_files(clean), _nodes(spark))
    return gaps.refilter_headline(audits, kinds)


@query(CTE + f", {world.AUDITS.strip()} SELECT o, 'f.yml' AS path, idents, fixes FROM au WHERE verdict = 'gap'")
def open_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a gap was found in, with their texts: what patches are tried on."""
    audits, clean, forge = _audits(spark, sf_dir)
    targets = chain.gap_targets(audits, clean, forge["file_at_ref"], world.scans(spark))
    left = audits.filter("verdict = 'gap'").select(*chain.COMMIT, "branch", "idents_present")
    pairs = evaluation.gap_pairs(audits, left.join(targets.select(*chain.COMMIT, "branch", "path", "target_idents"), [*chain.COMMIT, "branch"]))
    return pairs.select(_number().alias("o"), "path", F.array_join("idents_present", ",").alias("idents"), F.array_join("target_idents", ",").alias("fixes"))


def _histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits, clean, forge = _audits(spark, sf_dir)
    return settle(chain.branch_histories(audits, clean, forge["file_history"], forge["file_at_ref"], world.scans(spark), forge["commit_info"]))


@query(CTE + f", {world.AUDITS.strip()} SELECT o, branch, path, raw AS status, reason, version AS backport_version, n_read::BIGINT AS n_read, round(lag, 6) AS lag_days, refined FROM hr")
def branch_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _histories(spark, sf_dir)
    return found.select(_number().alias("o"), "branch", "path", "status", "reason", "backport_version", "n_read", F.round("lag_days", 6).alias("lag_days"), "refined")


@query(CTE + f", {world.AUDITS.strip()} SELECT o, branch, path, raw AS status, reason, version AS backport_version, n_read::BIGINT AS n_read, round(lag, 6) AS lag_days, refined FROM hr")
def history_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same histories walked in rounds: two versions at a time are fetched and scanned, of open branches alone."""
    audits, clean, forge = _audits(spark, sf_dir)
    files = settle(forge["file_at_ref"].withColumnRenamed("ref", "commit_sha"))
    fetch = lambda asked: files.join(asked, ["repository", "commit_sha", "path"], "left_semi")
    found, _ = chain.rounds_of_histories(audits, clean, forge["file_history"], forge["commit_info"], fetch, lambda blobs: scanner.scan(blobs, world.check), step=2)
    return found.select(_number().alias("o"), "branch", "path", "status", "reason", "backport_version", "n_read", F.round("lag_days", 6).alias("lag_days"), "refined")


@query(CTE + f", {world.AUDITS.strip()} SELECT refined, count(*) AS n FROM hr WHERE refined = 'true_backport' AND version IS NOT NULL GROUP BY refined")
def true_backport_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.true_backports(_histories(spark, sf_dir)).groupBy("refined").agg(F.count("*").alias("n"))


@query(CTE + f", {world.AUDITS.strip()}" + """
, b AS (SELECT o, n, branch, any_value(fixes) AS fixes, CASE WHEN bool_or(raw = 'confirmed_backport') THEN 'confirmed_backport' WHEN bool_or(raw = 'never_had_it') THEN 'never_had_it' ELSE 'inconclusive' END AS raw,
          max(lag) AS lag FROM hr GROUP BY o, n, branch),
r AS (SELECT *, CASE WHEN raw <> 'confirmed_backport' THEN raw WHEN lag > 1 THEN 'true_backport' WHEN lag < -1 THEN 'independent_prior_fix' ELSE 'same_day_fix' END AS refined FROM b)
SELECT 'status' AS part, refined AS name, count(*) AS n FROM r GROUP BY refined
UNION ALL SELECT 'ident', ident || ' ' || refined, count(*) FROM (SELECT unnest(string_split(fixes, ',')) AS ident, refined FROM r WHERE raw = 'confirmed_backport') GROUP BY ALL
UNION ALL SELECT 'reason', 'no_scannable_history', count(*) FROM r WHERE refined = 'inconclusive'
UNION ALL SELECT 'cluster', 'r' || n, count(*) FROM r WHERE refined = 'true_backport' AND lag > 30 AND lag <= 90 GROUP BY n
UNION ALL SELECT 'listed', 'true_backport', count(*) FROM r WHERE refined = 'true_backport'""")
def history_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _histories(spark, sf_dir)
    idents = _clean(spark, sf_dir).select(*chain.COMMIT, "V_fixed_idents")
    rolled = history.branch_roll_up(files, [*chain.COMMIT, "branch"]).withColumn("refined", refined_status(F.col("status"), F.col("lag_days")))
    branches = settle(rolled.join(idents, chain.COMMIT))
    status, by_ident = history.history_summary(branches)
    open_ = files.join(branches.filter("refined = 'inconclusive'").select(*chain.COMMIT, "branch"), [*chain.COMMIT, "branch"], "left_semi")
    reasons = history.inconclusive_reasons(open_, [*chain.COMMIT, "branch"], "path").groupBy("reason").agg(F.count("*").alias("n"))
    listed = history.true_backports(branches, [*chain.COMMIT, "branch"]).groupBy("refined").agg(F.count("*").alias("n"))
    part = lambda rows, part, name: rows.select(F.lit(part).alias("part"), name.alias("name"), "n")
    out = part(status, "status", F.col("refined")).unionAll(part(by_ident, "ident", F.concat_ws(" ", "ident", "refined"))).unionAll(part(reasons, "reason", F.col("reason")))
    return out.unionAll(part(history.lag_cluster(branches), "cluster", F.col("repository"))).unionAll(part(listed, "listed", F.col("refined")))


@query(CTE + """
SELECT o, CASE WHEN unread THEN 'blob_missing' WHEN NOT (perm OR pin) OR worse THEN 'not_clean_fix' WHEN kind <> 'structural' THEN 'host_removed' WHEN status = 'ok' THEN 'audited' ELSE 'audit_failed' END AS outcome,
       CASE WHEN unread THEN NULL WHEN NOT (perm OR pin) THEN 'no_v_fixed' WHEN worse THEN 'v_introduced_nonempty' WHEN kind = 'structural' AND status <> 'ok' THEN status END AS reason FROM c""")
def incremental_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental driver over an index in two files, so that commits are spread over two batches."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    world.index(spark, sf_dir).repartition(2, "file_path").write.option("header", True).csv(f"{folder}/index")
    catalog = Catalog(spark, f"{folder}/catalog")
    for name, rows in world.forge(spark, sf_dir).items():
        catalog.replace(name, rows)
    held = world.blobs(spark)
    scan = lambda hashes: scanner.scan(held.select("file_hash", "content").join(hashes, "file_hash", "left_semi"), world.check)
    run_available(spark, f"{folder}/index", catalog, scan, lambda hashes: held.select("file_hash", "text").join(hashes, "file_hash", "left_semi"), f"{folder}/state", files_per_batch=1, log_errors=False)
    return catalog.log("outcomes").select(_number().alias("o"), "outcome", "reason")


@query(CTE + f"""
, s AS (SELECT o, file, unnest(['before', 'after']) AS side, k FROM f WHERE o IN (SELECT o FROM clean))
SELECT o, side || '__' || replace(file, '.yml', '') || '.yml' AS name, md5(CASE WHEN side = 'before' THEN {world.BEFORE} ELSE {world.AFTER} END) AS digest FROM s""")
def commit_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The human-readable export of clean fixes as a table of files."""
    clean = _clean(spark, sf_dir)
    out = files_of.commit_export(clean, world.blobs(spark).select("file_hash", "text"))
    folder = clean.select(F.concat_ws("__", F.replace("repository", F.lit("/"), F.lit("__")), F.substring("commit_hash", 1, 10)).alias("dir"), _number().alias("o"))
    return out.join(folder, "dir").select("o", "name", F.md5("text").alias("digest"))


_TARGET = world.BEFORE.replace("k % ", "m % ").replace("CAST(k AS", "CAST(m AS")
SUPPLIERS = f"""
s AS (SELECT *, (k + 1) % 42 AS m FROM (SELECT s_suppkey AS s, s_suppkey % 42 AS k FROM supplier)),
d AS (SELECT *, {_TARGET} AS target FROM s)"""


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(program, k, m, before, after, text): a supplier's pair of versions, and the earlier version of the next pair."""
    s = table(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS program", "s_suppkey % 42 AS k").selectExpr("*", "(k + 1) % 42 AS m")
    return s.selectExpr("program", "program AS target", "k", "m", f"{world.BEFORE} AS before", f"{world.AFTER} AS after", f"{_TARGET} AS text")


def _patched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Programs of permission and pin fixes alone; the other suppliers have none. The tag v1 can't be resolved."""
    docs = settle(_programs(spark, sf_dir))
    plain = docs.filter("k % 6 < 2")
    edits = patches.compile_edits(*[document_nodes(plain, ["program"], text=c) for c in ("before", "after")], ["program"])
    pins = spark.createDataFrame([("acme/fetch", f"v{i}", "2" * 40) for i in (0, 2)], "action string, ref string, sha string")
    return (docs, *chain.patch_run(docs.select("program", "target", "text"), edits, pins))


_PATCHED = "CASE WHEN k % 6 = 0 THEN replace(target, 'write-all', 'read-all') WHEN k % 6 = 1 AND m % 3 <> 1 THEN replace(target, 'fetch@v' || (m % 3), 'fetch@' || repeat('2', 40) || ' # v' || (m % 3)) WHEN k % 6 = 1 THEN target END"


@query(f"WITH {SUPPLIERS.strip()} SELECT s::VARCHAR AS program, CASE WHEN k % 6 < 2 THEN 'patched' ELSE 'no_program' END AS status, {_PATCHED} AS patched_text FROM d")
def patch_all_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs on all targets; those without one are kept, as such."""
    _, runs, _, patched = _patched(spark, sf_dir)
    return runs.select("program", "target", "status").join(patched, ["program", "target"], "left").select("program", "status", "patched_text")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both oracles on every patched text; the linter objects to one in seven."""
    docs, runs, outcomes, patched = _patched(spark, sf_dir)
    keys = ["program", "target"]
    known = docs.select(*keys, F.array(F.when(F.col("k") % 6 == 0, "perm").otherwise("pin")).alias("target_idents"))

    def findings(texts: DataFrame) -> DataFrame:
        blobs = texts.select(F.sha2("text", 256).alias("file_hash"), F.encode("text", "UTF-8").alias("content"))
        found = scanner.scan(blobs, world.check).select("file_hash", F.explode("findings").alias("_f"))
        return texts.select(*keys, F.sha2("text", 256).alias("file_hash")).join(found, "file_hash").select(*keys, "_f.ident", "_f.route")

    lint = docs.filter("k % 7 = 3").select(*keys, F.lit("syntax").alias("kind"), F.lit("odd").alias("message"))
    return chain.judge_run(runs, outcomes, known, findings(docs.select(*keys, "text")), findings(patched.select(*keys, F.col("patched_text").alias("text"))), lint)


@query(f"""
WITH {SUPPLIERS.strip()}
SELECT s::VARCHAR AS program, bucket, bucket = 'accepted' AS accepted FROM (
  SELECT s, CASE WHEN k % 6 > 1 THEN 'fetch_or_compile_error' WHEN k % 6 = 1 AND m % 3 = 1 THEN 'needs_review_only' WHEN k % 7 = 3 THEN 'failed_actionlint' ELSE 'accepted' END AS bucket FROM d)""")
def patch_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("program", "bucket", "accepted")


@query(f"WITH {SUPPLIERS.strip()} SELECT s::VARCHAR AS program, replace(target, 'fetch@v' || (m % 3), 'fetch@' || repeat('1', 40)) AS patched_text FROM d WHERE k % 6 = 1")
def version_bump_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other generator: versions of actions that a fix changed, changed on the target."""
    docs = settle(_programs(spark, sf_dir))
    before, after, target = (settle(document_nodes(docs, ["program"], text=c)) for c in ("before", "after", "text"))
    bumps = generators.version_bumps(before, after, ["program"])
    sites = generators.bump_sites(bumps, target, docs.select("program"), ["program"], ["program"])
    return patches.patched_texts(docs, settle(sites), ["program"], ["program"])


@query(f"""
WITH {SUPPLIERS.strip()}
SELECT s::VARCHAR AS program, generator, CASE
  WHEN generator = 'bump' THEN CASE WHEN k % 6 = 1 THEN replace(target, 'fetch@v' || (m % 3), 'fetch@' || repeat('1', 40)) END
  WHEN k % 6 = 0 THEN replace(target, 'write-all', 'read-all') WHEN k % 6 = 4 AND k <> 40 THEN target || CASE WHEN floor(k / 6) % 2 = 1 THEN 'debug: true' ELSE 'name: x' END || chr(10) ELSE target END AS output
FROM d, (SELECT unnest(['hunk', 'bump']) AS generator)""")
def generator_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the other generators make of every target; a hunk that isn't found leaves the target as it is."""
    docs = settle(_programs(spark, sf_dir))
    return generators.outputs(docs.select("program", "before", "after", F.col("text").alias("target")), ["program"])


@query(f"""
WITH {SUPPLIERS.strip()}
SELECT count(*) AS n, count(*) FILTER (k % 6 < 2) AS n_patched, count(*) FILTER (k % 6 = 0 OR k % 6 = 1 AND m % 3 <> 1) AS n_local_ok, count(*) FILTER (k % 6 < 2 AND k % 7 <> 3) AS n_lint_ok,
       count(*) FILTER ((k % 6 = 0 OR k % 6 = 1 AND m % 3 <> 1) AND k % 7 <> 3) AS n_accepted, count(*) FILTER (k % 6 = 1 AND m % 3 = 1) AS n_review FROM d""")
def oracle_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.oracle_counters(_judged(spark, sf_dir))


@query(CTE + f", {world.AUDITS.strip()}" + f"""
SELECT o, 's1' AS backport_sha, 's2' AS parent_sha, (SELECT {world.BEFORE} FROM (SELECT 0 AS k)) AS parent_text, (SELECT {world.AFTER} FROM (SELECT 2 AS k)) AS human_text FROM hr WHERE refined = 'true_backport'""")
def backport_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True back-ports with their first parents and both texts."""
    forge = world.forge(spark, sf_dir)
    found = evaluation.backport_cases(_histories(spark, sf_dir), forge["commit_info"], forge["file_at_ref"])
    return found.select(_number().alias("o"), "backport_sha", "parent_sha", "parent_text", "human_text")


@query(CTE + """
SELECT o, count(*) AS n_files FROM f WHERE o % 4 <> 0 GROUP BY o""")
def commits_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index without the commits that a log has."""
    rows = world.index(spark, sf_dir)
    left = sampling.commits_to_do(rows, rows.filter(_number() % 4 == 0))
    return left.select(_number().alias("o"), F.size("files").cast("long").alias("n_files"))


@query(CTE + LINES + "SELECT DISTINCT fixes, template_hash FROM ct")
def pattern_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog written as JSON lines and read back by set."""
    folder = f"{shared_folder(spark)}/patterns-{uuid.uuid4().hex}"
    files_of.write_jsonl(chain.pattern_catalog(_templates(spark, sf_dir)), folder)
    return files_of.read_patterns(spark, folder)


@query("""
WITH s AS (SELECT s_suppkey AS s, s_suppkey % 7 AS v FROM supplier)
SELECT s::VARCHAR AS program, CASE v WHEN 0 THEN 'missing_backport_sha' WHEN 1 THEN 'no_parent_commit' WHEN 2 THEN 'file_absent_at_parent_or_backport' WHEN 3 THEN 'no_program'
  WHEN 4 THEN 'byte_equal' WHEN 5 THEN 'ast_equal' ELSE CASE WHEN s % 2 = 0 THEN 'effect_equal' ELSE 'divergent' END END AS outcome FROM s""")
def human_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patched texts beside those that people committed: bytes, then trees, then findings."""
    rows = table(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS program", "s_suppkey AS s", "s_suppkey % 7 AS v")
    rows = rows.selectExpr(
        "program", "CASE WHEN v <> 0 THEN 'b' END AS backport_sha", "CASE WHEN v <> 1 THEN 'p' END AS parent_sha", "'a: 1' AS parent_text", "CASE WHEN v <> 2 THEN 'a: ' || program || chr(10) END AS human_text",
        "CASE v WHEN 3 THEN NULL WHEN 4 THEN 'a: ' || program || chr(10) WHEN 5 THEN '# note' || chr(10) || 'a:   ' || program || chr(10) ELSE 'b: 2' || chr(10) END AS patched_text", "s % 2 = 0 AS effect",
    )
    return evaluation.compare_with_human(rows, ["program"]).select("program", "outcome")


@query("""
WITH s AS (SELECT s_suppkey % 7 AS v, s_suppkey % 2 AS w FROM supplier)
SELECT count(*) AS n, count(*) FILTER (v IN (4, 5) OR v = 6 AND w = 0) AS n_reproduced, count(*) FILTER (v = 4) AS n_byte_equal, count(*) FILTER (v = 5) AS n_ast_equal,
       count(*) FILTER (v = 6 AND w = 0) AS n_effect_equal, count(*) FILTER (v = 6 AND w = 1) AS n_divergent FROM s""")
def reproduction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reproduction(human_comparison(spark, sf_dir))
