"""Oracles, generators, caches, logs and scalar functions on the driver's tables, each through its operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import patchtext
from ..functions.columns import commit_folder, days_between, equality_step, host_of_route, percent, value_sketch
from ..operators import diffs, evaluation, gaps, history, reports, sampling, scopes
from ..operators.lineage import shared_folder
from ..sources import remote, tables as files_of
from .tables import shipping_lags, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Findings before and after a patch: an order's first three lines, and those from the second on. Some occur twice.
_FINDINGS = """
l AS (SELECT l_orderkey AS o, l_linenumber AS i, l_returnflag AS ident, 'jobs.j' || l_linestatus AS scope, 'jobs.j' || l_linestatus || '.steps[' || (l_suppkey % 2) || ']' AS route FROM lineitem),
b AS (SELECT * FROM l WHERE i <= 3), a AS (SELECT * FROM l WHERE i >= 2),
sc AS (SELECT DISTINCT o, scope FROM l WHERE ident <> 'A')"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = F.concat(F.lit("jobs.j"), "l_linestatus")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ordinal"), F.col("l_returnflag").alias("ident"), job.alias("_scope"), F.concat(job, F.lit(".steps["), F.col("l_suppkey") % 2, F.lit("]")).alias("route"))


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    programs = rows.select("o").distinct().withColumn("target_idents", F.array(F.lit("R"), F.lit("X")))
    return programs, rows.filter("ordinal <= 3").select("o", "ident", "route"), rows.filter("ordinal >= 2").select("o", "ident", "route")


@query(f"""
WITH {_FINDINGS.strip()},
n AS (SELECT o, count(*) AS n FROM sc GROUP BY o),
x AS (SELECT a.o, count(*) AS n FROM a JOIN sc ON a.o = sc.o AND a.scope = sc.scope WHERE ident = 'R' GROUP BY a.o),
i AS (SELECT w.o, count(*) AS n FROM (SELECT DISTINCT o, ident, route, scope FROM a) w JOIN sc ON w.o = sc.o AND w.scope = sc.scope
      WHERE NOT EXISTS (FROM b WHERE b.o = w.o AND b.ident = w.ident AND b.route = w.route) GROUP BY w.o)
SELECT l.o, coalesce(n.n, 0) AS n_scopes, coalesce(x.n, 0) AS n_failed, coalesce(i.n, 0) AS n_introduced, coalesce(n.n, 0) > 0 AND x.n IS NULL AND i.n IS NULL AS success
FROM (SELECT DISTINCT o FROM l) l LEFT JOIN n ON n.o = l.o LEFT JOIN x ON x.o = l.o LEFT JOIN i ON i.o = l.o""")
def local_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Did a patch fix what it touched? Findings that occur twice count twice."""
    rows = _findings(spark, sf_dir)
    outcomes = rows.withColumn("status", F.when(F.col("ident") == "A", "inapplicable").otherwise("applied"))
    programs, before, after = _sides(rows)
    return scopes.local_oracle(programs, scopes.landed_scopes(outcomes, ["o"], F.col("_scope")), before, after, ["o"])


@query(f"""
WITH {_FINDINGS.strip()},
r AS (SELECT o, ident, route, max(b) AS b, max(a) AS a FROM (SELECT o, ident, route, 1 AS b, 0 AS a FROM b UNION ALL SELECT o, ident, route, 0, 1 FROM a) GROUP BY ALL),
i AS (SELECT o, ident, sum(b) AS b, sum(a) AS a, count(*) FILTER (a = 1 AND b = 0) AS new FROM r GROUP BY o, ident)
SELECT o, count(*) FILTER (ident = 'R' AND b > 0 AND a < b) AS n_reduced, sum(new)::BIGINT AS n_introduced, count(*) FILTER (ident = 'R' AND b > 0 AND a < b) > 0 AND sum(new) = 0 AS success FROM i GROUP BY o""")
def global_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.global_oracle(*_sides(_findings(spark, sf_dir)), ["o"])


@query(f"""
WITH {_FINDINGS.strip()},
t AS (SELECT o, bool_or(i <= 3 AND ident = 'R') AS b, bool_or(i >= 2 AND ident = 'R') AS a FROM l GROUP BY o)
SELECT o, CASE WHEN b THEN 'R' ELSE '' END AS present, CASE WHEN b THEN 'X' ELSE 'R,X' END AS absent, CASE WHEN b AND NOT a THEN 'R' ELSE '' END AS resolved, CASE WHEN b AND a THEN 'R' ELSE '' END AS missed FROM t""")
def target_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scopes.target_sets(*_sides(_findings(spark, sf_dir)), ["o"])
    return found.select("o", *[F.array_join(c, ",").alias(c) for c in ("present", "absent", "resolved", "missed")])


@query("SELECT l_orderkey AS o, l_returnflag AS kind, '' AS message, count(*) AS n FROM lineitem GROUP BY ALL")
def lint_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linter's raw answers without their places."""
    fault = F.struct(F.col("l_returnflag").alias("kind"), F.lit(None).cast("string").alias("message"), F.col("l_linenumber").alias("line"))
    raw = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_list(fault).alias("faults"))
    return scopes.lint_keys(raw, ["o"]).groupBy("o", "kind", "message").agg(F.count("*").alias("n"))


@query("""
SELECT o, string_agg(ident || '/' || sev || '/' || route, ',' ORDER BY i, ident, sev, route) AS findings FROM (
  SELECT l_orderkey AS o, l_linenumber AS i, l_returnflag AS ident, CASE WHEN l_linestatus = 'O' THEN 'high' ELSE '' END AS sev, CASE WHEN l_linenumber > 1 THEN 'r' || l_suppkey ELSE '' END AS route FROM lineitem) GROUP BY o""")
def normalised_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw findings with lists of places, of which the first counts; what's missing is empty."""
    routes = F.when(F.col("l_linenumber") > 1, F.array(F.concat(F.lit("r"), "l_suppkey"), F.lit("second"))).otherwise(F.array().cast("array<string>"))
    raw = F.struct(F.col("l_linenumber").alias("i"), F.col("l_returnflag").alias("ident"), F.when(F.col("l_linestatus") == "O", "high").alias("severity"), F.lit(None).cast("string").alias("confidence"), routes.alias("routes"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(raw)).alias("_f"))
    text = F.transform(diffs.normalise_findings(F.col("_f")), lambda f: F.concat_ws("/", f["ident"], f["severity"], f["route"]))
    return rows.select("o", F.array_join(text, ",").alias("findings"))


@query("""
WITH x AS (
  SELECT l_orderkey AS o, l_linenumber AS i, CASE l_returnflag WHEN 'R' THEN 'scan_error' ELSE CASE WHEN l_linestatus = 'O' THEN 'history_cap_reached' ELSE 'unknown' END END AS reason
  FROM lineitem WHERE l_returnflag IN ('A', 'R')),
g AS (SELECT o, reason, count(*) AS n, min(i) AS f FROM x GROUP BY o, reason)
SELECT o, reason, n FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n DESC, f, reason) AS r FROM g) WHERE r = 1""")
def inconclusive_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "inconclusive").when(F.col("l_returnflag") == "R", "error").otherwise("never_had_it")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), status.alias("status"), F.when(F.col("l_linestatus") == "O", "history_cap_reached").alias("reason"), F.col("l_linenumber").alias("i"))
    return history.inconclusive_reasons(rows, ["o"], "i")


@query("""
SELECT generator, outcome, count(*) AS n FROM (
  SELECT CASE l_linenumber % 2 WHEN 0 THEN 'hunk' ELSE 'bump' END AS generator,
         CASE WHEN l_linenumber = 1 THEN 'no_output' WHEN l_linenumber = 2 THEN 'oracle_error' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'accepted'
              WHEN l_returnflag <> 'N' THEN 'failed_zizmor' ELSE 'failed_actionlint' END AS outcome FROM lineitem) GROUP BY ALL""")
def generator_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each generator's output, counted by generator."""
    i = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(i % 2 == 0, "hunk").otherwise("bump").alias("generator"), F.when(i == 1, "  ").otherwise("text").alias("output"), F.when(i == 2, "error").otherwise("ok").alias("oracle_status"),
        (F.col("l_returnflag") == "N").alias("oracle_ok"), (F.col("l_linestatus") == "O").alias("lint_ok"),
    )
    judged = evaluation.generator_outcome(rows)
    return reports.generator_counts(judged.select(F.create_map("generator", "outcome").alias("outcomes")))


@query("""
SELECT ident, count(*) AS n, count(*) FILTER (bucket = 'accepted') AS n_accepted, round(count(*) FILTER (bucket = 'accepted') / count(*), 6) AS acceptance FROM (
  SELECT unnest([l_returnflag, 'all']) AS ident, CASE WHEN l_linestatus = 'O' THEN 'accepted' ELSE 'other' END AS bucket FROM lineitem) GROUP BY ident""")
def acceptance_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.array("l_returnflag", F.lit("all")).alias("target_idents"), F.when(F.col("l_linestatus") == "O", "accepted").otherwise("other").alias("bucket"))
    return reports.acceptance_by_rule(rows)


@query("""
WITH p AS (SELECT l_orderkey AS o, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS n_programs, sum(n)::BIGINT AS n_edits, sum(r)::BIGINT AS n_review, count(*) FILTER (r = 0) AS n_automatable FROM p""")
def compile_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("program"), F.when(F.col("l_returnflag") == "R", "adds a list element").alias("review"))
    return evaluation.compile_counters(edits)


@query("""
WITH e AS (SELECT o_orderkey AS o, 'r/' || (o_custkey % 50) AS r, CASE o_orderkey % 3 WHEN 0 THEN 'branches_error' ELSE 'ok' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'structural' WHEN 1 THEN 'mixed' WHEN 2 THEN 'deletion' ELSE 'unknown' END AS kind FROM orders)
SELECT o, outcome, CASE WHEN outcome = 'audit_failed' THEN status END AS reason, 'r__' || substr(r, 3) || '__c' || substr(o::VARCHAR, 1, 9) AS dir, kind AS host_classification FROM (
  SELECT *, CASE WHEN kind IN ('mixed', 'deletion') THEN 'host_removed' WHEN status = 'ok' THEN 'audited' ELSE 'audit_failed' END AS outcome FROM e)""")
def import_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another tag's audits taken over as outcomes."""
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(o.alias("o"), F.concat(F.lit("r/"), F.col("o_custkey") % 50).alias("repository"), F.concat(F.lit("c"), o).alias("commit_hash"), F.when(o % 3 == 0, "branches_error").otherwise("ok").alias("status"))
    kinds = rows.filter("o % 4 < 3").select("repository", "commit_hash", F.when(F.col("o") % 4 == 0, "structural").when(F.col("o") % 4 == 1, "mixed").otherwise("deletion").alias("kind"))
    found = evaluation.import_tag(rows.drop("o"), kinds, "earlier")
    return found.select(F.substring("commit_hash", 2, 20).cast("long").alias("o"), "outcome", "reason", "dir", "host_classification")


@query("""
WITH a AS (SELECT doc_id::VARCHAR AS h, quality = 1 AS ok FROM labels), b AS (SELECT doc_id::VARCHAR AS h, toxic = 1 AS ok FROM labels WHERE doc_id % 3 = 0)
SELECT a.h AS file_hash, coalesce(b.ok, a.ok) AS ok, CASE WHEN b.h IS NULL THEN 'first' ELSE 'second' END AS error FROM a LEFT JOIN b ON a.h = b.h""")
def merged_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of two sources written and read back, the later source first, broken lines left out."""
    labels, folder = table(spark, sf_dir, "labels"), f"{shared_folder(spark)}/jsonl-{uuid.uuid4().hex}"
    row = lambda ok, error: (F.col("doc_id").cast("string").alias("file_hash"), ok.alias("ok"), F.lit(error).alias("error"), F.array().cast("array<struct<ident:string,severity:string,confidence:string,route:string>>").alias("findings"))
    files_of.write_jsonl(labels.select(*row(F.col("quality") == 1, "first")), f"{folder}/1")
    files_of.write_jsonl(labels.filter("doc_id % 3 = 0").select(*row(F.col("toxic") == 1, "second")), f"{folder}/2")
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.mode("append").text(f"{folder}/2")
    merged = files_of.merge_scans(*[files_of.read_jsonl(spark, f"{folder}/{i}", "scans") for i in (1, 2)])
    return merged.select("file_hash", "ok", "error")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN CASE WHEN d.doc_id % 2 = 0 THEN 'fetched' ELSE 'fetched, missing' END WHEN l.quality = 0 THEN 'missing' ELSE 'known' END AS state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def read_through_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache with negative entries: what it lacks is fetched, and what has no answer becomes a negative entry."""
    cache = table(spark, sf_dir, "labels").select("doc_id", F.lit("cached").alias("answer"), (F.col("quality") == 0).alias("missing"))
    fetch = lambda keys: keys.filter("doc_id % 2 = 0").withColumn("answer", F.lit("new"))
    answers, new = remote.read_through(table(spark, sf_dir, "documents").select("doc_id"), cache, ["doc_id"], fetch)
    fresh = new.select("doc_id", F.lit(True).alias("_new"))
    state = F.when(F.col("_new") & F.col("missing"), "fetched, missing").when(F.col("_new"), "fetched").when(F.col("missing"), "missing").otherwise("known")
    return answers.join(fresh, "doc_id", "left").select("doc_id", state.alias("state"))


@query("SELECT doc_id, '0' AS kept FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log has isn't done again; its rows without a whole key don't count."""
    log = table(spark, sf_dir, "labels").select("doc_id").unionAll(spark.createDataFrame([(None,)], "doc_id long"))
    return gaps.not_done(table(spark, sf_dir, "documents").select("doc_id"), files_of.done_keys(log, ["doc_id"]), ["doc_id"]).withColumn("kept", F.lit("0"))


@query("""
SELECT l_orderkey, l_linenumber, printf('%.1f%%', 100.0 * l_linenumber / 7) AS share, 'o__r' || l_suppkey || '__' || substr('abc' || l_partkey || '0000000000', 1, 10) AS dir,
       round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0, 6) AS days,
       CASE WHEN l_returnflag = 'A' THEN 'byte_equal' WHEN l_linestatus = 'O' THEN 'ast_equal' WHEN l_linenumber < 3 THEN 'effect_equal' ELSE 'divergent' END AS step
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    folder = commit_folder(F.concat(F.lit("o/r"), "l_suppkey"), F.concat(F.lit("abc"), "l_partkey", F.lit("0000000000")))
    step = equality_step(F.col("l_returnflag") == "A", F.col("l_linestatus") == "O", F.col("l_linenumber") < 3)
    return lines.select("l_orderkey", "l_linenumber", percent(F.col("l_linenumber"), F.lit(7)).alias("share"), folder.alias("dir"), F.round(days_between(F.col("o_orderdate"), F.col("l_shipdate")), 6).alias("days"), step.alias("step"))


@query("""
SELECT page_id, ['step', 'service', 'job', 'root', 'step'][i] AS kind, ['j' || page_id, 'a', 'b', NULL, 'c'][i] AS job, [NULL, 'db', NULL, NULL, NULL][i] AS service, ['2', NULL, NULL, NULL, '11'][i] AS step
FROM (SELECT page_id, (page_id % 5 + 1)::INT AS i FROM pages)""")
def route_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(F.concat(F.lit("jobs.j"), F.col("page_id").cast("string"), F.lit(".steps[2].run")), *[F.lit(x) for x in ("jobs.a.services.db.image", "jobs.b.permissions", "permissions.contents", "jobs.c.steps[11]")])
    return table(spark, sf_dir, "pages").select("page_id", host_of_route(F.element_at(forms, (F.col("page_id") % 5 + 1).cast("int"))).alias("h")).select("page_id", "h.kind", "h.job", "h.service", F.col("h.step").cast("string").alias("step"))


@query("SELECT e AS event_id, 'list[' || (e % 4) || ']' AS list, 'obj[' || (e % 3) || ']' AS map FROM (SELECT event_id AS e FROM events)")
def complex_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    numbers = F.slice(F.array(*[F.lit(i) for i in range(3)]), F.lit(1), (e % 4).cast("int"))
    entries = F.slice(F.array(*[F.struct(F.lit(k), F.lit(1)) for k in "ab"]), F.lit(1), (e % 3).cast("int"))
    row = table(spark, sf_dir, "events").select(e, F.to_json(numbers).alias("_l"), F.to_json(F.map_from_entries(entries)).alias("_m"))
    return row.select("event_id", value_sketch(F.lit("list"), F.col("_l")).alias("list"), value_sketch(F.lit("map"), F.col("_m")).alias("map"))


@query("SELECT s_suppkey, 'jobs|a' || s_suppkey || '|steps|[uses=x/y.z[' || s_nationkey || '[q]]~0]|with|[b~2]' AS parts FROM supplier")
def path_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths whose list identities hold brackets of their own, at any depth."""
    path = F.concat(F.lit("jobs.a"), "s_suppkey", F.lit(".steps[uses=x/y.z["), "s_nationkey", F.lit("[q]]~0].with[b~2]"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(patchtext.path_segments(path), "|").alias("parts"))


@query("SELECT o_custkey, n, r AS rank FROM (SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS r FROM orders GROUP BY o_custkey) WHERE r <= 20")
def ranked_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return reports.ranked(counts, "n", ["o_custkey"], 20)


@query("""
WITH m AS (SELECT md5(text) AS h, count(DISTINCT source) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1)
SELECT count(*) AS n_mirrored, coalesce(sum(n - 1), 0)::BIGINT AS n_excess FROM m""")
def mirror_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.excess_copies(reports.mirrors(table(spark, sf_dir, "documents"), F.md5("text"), "source"))


@query("""
WITH g AS (SELECT l_orderkey, l_suppkey, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE AS lag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_suppkey, count(*) AS n FROM g WHERE lag > 30 AND lag <= 90 GROUP BY l_suppkey""")
def lag_range_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shipping_lags(spark, sf_dir).withColumn("refined", F.lit("true_backport"))
    return history.lag_cluster(rows, repo="l_suppkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def valid_modifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter of the index itself, on an index made of line items."""
    yes = lambda c: F.when(c, "True").otherwise("False")
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("r").alias("repository"), F.col("l_orderkey").cast("string").alias("commit_hash"), F.lit("d").alias("committed_date"), F.col("l_linenumber").cast("string").alias("file_path"),
        F.when(F.col("l_returnflag") != "A", "new").alias("file_hash"), F.lit("old").alias("previous_file_hash"), F.when(F.col("l_returnflag") == "N", "A").otherwise("M").alias("git_change_type"),
        yes(F.lit(True)).alias("valid_yaml"), yes(F.col("l_linenumber") > 0).alias("valid_workflow"), F.lit("False").alias("probably_workflow"),
    )
    return sampling.valid_modifications(rows).select(F.col("commit_hash").cast("long").alias("l_orderkey"), F.col("file_path").cast("int").alias("l_linenumber"))


@query("SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def structural_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose commit is of the kind ``structural``, by the operator itself."""
    key = lambda rows: rows.withColumns({"repository": F.lit("r"), "commit_hash": F.col("doc_id").cast("string")})
    kinds = key(table(spark, sf_dir, "labels")).select("repository", "commit_hash", F.when(F.col("quality") == 1, "structural").otherwise("deletion").alias("kind"))
    return gaps.structural_only(key(table(spark, sf_dir, "documents").select("doc_id", "source")), kinds).select("doc_id", "source")
