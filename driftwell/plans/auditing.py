"""Branch audits, histories and lags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import RELEASE_PATTERN, is_release_branch, refined_status
from ..operators import gaps, history, hosts, reports
from .tables import audited, shipping_lags, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Branch names over the orders: the data has none of its own.
NAMES = ["release/1.x", "main", "v2", "feature/x", "LTS", "releases-7", "v1.2-stable", "Stable", "maint/9", "maintenance", "4.x", "1.x-stable", "lts_8", "support/old", "v3.4.x", "hotfix/release", "version2", "develop"]


@query(f"""
WITH n AS (SELECT o_orderkey, {NAMES}[(o_orderkey % {len(NAMES)} + 1)::INT] AS branch FROM orders)
SELECT o_orderkey, branch FROM n WHERE regexp_matches(branch, '{RELEASE_PATTERN}') AND branch <> 'Stable'""")
def release_name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in NAMES])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(names, (F.col("o_orderkey") % len(NAMES) + 1).cast("int")).alias("branch"))
    return rows.filter(is_release_branch(F.col("branch"), F.lit("Stable")))


@query("SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def semi_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(good, "doc_id", "left_semi")


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return gaps.not_done(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("status")), ["doc_id"], "status", ("0",))


FILES = """
WITH f AS (
  SELECT l_orderkey AS o, l_suppkey AS s, CASE WHEN l_returnflag = 'A' THEN 'absent' WHEN l_quantity <= 2 THEN 'scan_failed' ELSE 'ok' END AS st,
         CASE WHEN l_returnflag = 'R' THEN 'R-' || l_linestatus END AS ident
  FROM lineitem),
v AS (
  SELECT o, s, CASE WHEN bool_or(st = 'ok' AND ident IS NOT NULL) THEN 'gap' WHEN bool_or(st <> 'absent') THEN 'already_fixed' ELSE 'inapplicable' END AS verdict,
         count(*) FILTER (st = 'scan_failed') AS n_scan_failed,
         coalesce(string_agg(DISTINCT ident, ',' ORDER BY ident) FILTER (st = 'ok'), '') AS idents
  FROM f GROUP BY o, s)
"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.branch_verdict(audited(spark, sf_dir), ["o", "s"])


@query(FILES + "SELECT o, s, verdict, n_scan_failed, idents FROM v")
def gap_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("o", "s", "verdict", "n_scan_failed", F.array_join("idents_present", ",").alias("idents"))


@query(FILES + """
SELECT count(*) AS n_branches, count(*) FILTER (verdict = 'gap') AS n_gap, count(*) FILTER (verdict = 'already_fixed') AS n_fixed,
       count(*) FILTER (verdict = 'inapplicable') AS n_inapplicable,
       round(count(*) FILTER (verdict = 'gap') / count(*), 6) AS gap_rate,
       round(count(*) FILTER (verdict = 'gap') / count(*) FILTER (verdict <> 'inapplicable'), 6) AS actionable_rate FROM v""")
def gap_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.headline(_verdicts(spark, sf_dir))


@query(FILES + "SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM v WHERE verdict = 'gap' GROUP BY o) GROUP BY size")
def gap_summary_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(_verdicts(spark, sf_dir).filter("verdict = 'gap'"), ["o"])


@query(FILES + "SELECT s, count(*) AS n FROM v WHERE verdict = 'gap' GROUP BY s ORDER BY n DESC, s LIMIT 15")
def gap_top_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top(_verdicts(spark, sf_dir).filter("verdict = 'gap'"), ["s"])


@query(FILES + """
SELECT count(*) AS n_all, count(*) FILTER (g) AS n_gap, count(*) FILTER (x) AS n_fixed, count(*) FILTER (g AND x) AS n_both,
       count(*) FILTER (g OR x) AS n_either, count(*) FILTER (NOT g AND NOT x) AS n_neither
FROM (SELECT o_custkey, coalesce(bool_or(verdict = 'gap'), false) AS g, coalesce(bool_or(verdict = 'already_fixed'), false) AS x
      FROM orders LEFT JOIN v ON o_orderkey = o GROUP BY o_custkey)""")
def repo_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("o"))
    rows = orders.join(_verdicts(spark, sf_dir).select("o", "verdict"), "o", "left")
    return reports.repo_coverage(rows, "o_custkey", F.col("verdict") == "gap", F.col("verdict") == "already_fixed")


@query(FILES + """
SELECT ident, sum(g) AS n_gap, sum(x) AS n_fixed, round(sum(g) / (sum(g) + sum(x)), 6) AS rate
FROM (SELECT unnest(string_split(idents, ',')) AS ident, 1 AS g, 0 AS x FROM v WHERE verdict = 'gap'
      UNION ALL SELECT unnest(['R-F', 'R-O']), 0, 1 FROM v WHERE verdict = 'already_fixed')
GROUP BY ident""")
def gap_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = _verdicts(spark, sf_dir)
    left = verdicts.filter("verdict = 'gap'").select(F.explode("idents_present").alias("ident"))
    # Every ident of the commit counts once for each branch that is fixed already.
    fixed = verdicts.filter("verdict = 'already_fixed'").select(F.explode(F.array(F.lit("R-F"), F.lit("R-O"))).alias("ident"))
    return reports.gap_rate(left, fixed, "ident")


@query("""
WITH e AS (
  SELECT user_id, event_id, ts, value >= 5 AS scannable, event_type = 'error' AS hit,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
s AS (SELECT *, coalesce(sum(scannable::INT) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
n AS (SELECT user_id, count(*) FILTER (scannable AND before < 50) AS n_read, count(*) FILTER (before >= 50) AS more FROM s GROUP BY user_id),
i AS (SELECT *, lag(event_id) OVER w AS newer, lag(ts) OVER w AS newer_ts FROM s WHERE scannable AND before < 50 WINDOW w AS (PARTITION BY user_id ORDER BY r)),
f AS (SELECT user_id, arg_min({'v': newer, 'at': newer_ts}, r) AS b, true AS hit FROM i WHERE hit GROUP BY user_id)
SELECT user_id, n_read::BIGINT AS n_read, b.v::VARCHAR AS backport_version, strftime(b.at, '%Y-%m-%d %H:%M:%S') AS backported_at,
       CASE WHEN hit AND b.v IS NOT NULL THEN 'confirmed_backport' WHEN hit OR n_read = 0 OR more > 0 THEN 'inconclusive' ELSE 'never_had_it' END AS status,
       CASE WHEN hit AND b.v IS NOT NULL THEN NULL WHEN hit THEN 'fix_present_at_head_contradicts_already_fixed'
            WHEN n_read = 0 THEN 'no_scannable_history' WHEN more > 0 THEN 'history_cap_reached' END AS reason
FROM n LEFT JOIN f USING (user_id)""")
def history_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("value") >= 5).alias("ok"), (F.col("event_type") == "error").alias("hit"))
    found = history.history_boundary(versions, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], "event_id", "ts", "ok", "hit")
    return found.withColumn("backport_version", F.col("backport_version").cast("string")).withColumn("backported_at", F.date_format("backported_at", "yyyy-MM-dd HH:mm:ss"))


LAGS = """
WITH g AS (
  SELECT l_orderkey, l_suppkey, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE AS lag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


@query(LAGS + """
SELECT CASE WHEN lag > 1 THEN 'true_backport' WHEN lag < -1 THEN 'independent_prior_fix' ELSE 'same_day_fix' END AS refined, count(*) AS n
FROM g GROUP BY 1""")
def lag_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    lags = shipping_lags(spark, sf_dir).withColumn("refined", refined_status(F.lit("confirmed_backport"), F.col("lag_days")))
    return lags.groupBy("refined").agg(F.count("*").alias("n"))


@query(LAGS + """
SELECT CASE WHEN lag <= 7 THEN '1-7 d' WHEN lag <= 30 THEN '1-4 w' WHEN lag <= 90 THEN '1-3 mo' WHEN lag <= 365 THEN '3-12 mo' ELSE '>1 y' END AS bucket, count(*) AS n
FROM g WHERE lag > 1 AND lag <= 1000000000 GROUP BY 1""")
def lag_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.lag_histogram(shipping_lags(spark, sf_dir))


SHARES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}


@query(LAGS + f"""
, r AS (SELECT lag, row_number() OVER (ORDER BY lag) - 1 AS place, count(*) OVER () AS n FROM g WHERE lag > 1)
SELECT name, lag AS value FROM r JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in SHARES.items())}) s(name, share) ON place = least(floor(share * n), n - 1)""")
def lag_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.percentiles(shipping_lags(spark, sf_dir).filter("lag_days > 1"), "lag_days", SHARES)


@query(LAGS + "SELECT count(*) AS n, min(lag) AS min, max(lag) AS max, round(avg(lag), 6) AS mean FROM g WHERE lag > 1")
def lag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.lag_summary(shipping_lags(spark, sf_dir).filter("lag_days > 1"))


@query(LAGS + """
, f AS (SELECT l_orderkey, l_suppkey, lag, CASE WHEN lag > 1 THEN 'confirmed_backport' WHEN lag < -100 THEN 'never_had_it' ELSE 'inconclusive' END AS status FROM g)
SELECT l_orderkey, l_suppkey, count(*) AS n_files, max(lag) FILTER (status = 'confirmed_backport') AS lag_days,
       CASE WHEN bool_or(status = 'confirmed_backport') THEN 'confirmed_backport' WHEN bool_or(status = 'never_had_it') THEN 'never_had_it' ELSE 'inconclusive' END AS status
FROM f GROUP BY l_orderkey, l_suppkey""")
def branch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("lag_days") > 1, "confirmed_backport").when(F.col("lag_days") < -100, "never_had_it").otherwise("inconclusive")
    return history.branch_roll_up(shipping_lags(spark, sf_dir).withColumn("status", status), ["l_orderkey", "l_suppkey"])


@query("""
WITH f AS (SELECT l_orderkey AS o, l_suppkey AS s, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS k FROM lineitem GROUP BY ALL),
k AS (SELECT o, s, n, k, CASE WHEN k = n THEN 'structural' WHEN k = 0 THEN 'deletion' ELSE 'mixed' END AS kind FROM f)
SELECT o, CASE WHEN bool_and(kind = 'structural') THEN 'structural' WHEN bool_and(kind = 'deletion') THEN 'deletion' ELSE 'mixed' END AS kind FROM k GROUP BY o""")
def host_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"), (F.col("l_linestatus") == "O").alias("survived"))
    return hosts.commit_kind(hosts.file_kind(findings, ["o", "s"]), ["o"])


@query("""
SELECT o_custkey, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total, count(*) AS n_items, round(sum(o_totalprice::DECIMAL(18, 2))::DOUBLE / count(*), 6) AS average,
       max(o_totalprice::DECIMAL(18, 2))::DOUBLE AS greatest, arg_max(o_orderkey, (o_totalprice::DECIMAL(18, 2), -o_orderkey)) AS greatest_item FROM orders GROUP BY o_custkey""")
def repo_density_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    found = reports.density(orders, "o_custkey", "o_orderkey", "o_totalprice")
    return found.select("o_custkey", F.col("total").cast("double").alias("total"), "n_items", F.round(F.col("total").cast("double") / F.col("n_items"), 6).alias("average"), F.col("greatest").cast("double").alias("greatest"), "greatest_item")


@query("""
SELECT sha256(text) AS digest, count(DISTINCT source) AS n_repos, count(*) AS n_rows FROM documents
WHERE source IS NOT NULL GROUP BY text HAVING count(DISTINCT source) > 1""")
def mirror_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("source is not null")
    return reports.mirrors(docs, F.sha2("text", 256), "source")


@query("""
SELECT user_id, event_type AS reason, n FROM (
  SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(ts), event_type) AS r
  FROM events GROUP BY user_id, event_type) WHERE r = 1""")
def dominant_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("reason"), "ts")
    return history.dominant_reason(events, ["user_id"], "reason", "ts")
