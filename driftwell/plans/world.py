"""A small world of repositories made of the orders: commits, files, blobs, findings, branches and histories.

Expressions are SQL that Spark and DuckDB both read, so a query and its SQL share them. An order is a commit, a
customer's group a repository. A file's versions come from 42 pairs of blobs: k = order % 42 names a pair, k % 6 what its
change does (0 permission, 1 pin, 2 both in a renamed job, 3 job gone, 4 nothing or something worse, 5 permission in a
file whose job is gone); the later version of pair 40 can't be read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import SCHEMAS
from .tables import table

PAIRS, REPOS = 42, 50
_NL = "chr(10)"
JOB = "('j' || CAST(k % 4 AS STRING))"
PIN = "('acme/fetch@' || repeat('1', 40))"
BEFORE = f"('permissions: write-all' || {_NL} || 'jobs:' || {_NL} || '  ' || {JOB} || ':' || {_NL} || '    runs-on: n' || CAST(k AS STRING) || {_NL} || '    steps:' || {_NL} || '      - uses: acme/fetch@v' || CAST(k % 3 AS STRING) || {_NL} || '      - run: make' || {_NL})"
_READ = f"replace({BEFORE}, 'write-all', 'read-all')"
_PINNED = lambda text: f"replace({text}, 'acme/fetch@v' || CAST(k % 3 AS STRING), {PIN})"
_OTHER = lambda word: f"('permissions: {word}' || {_NL} || 'jobs:' || {_NL} || '  other:' || {_NL} || '    runs-on: n' || CAST(k AS STRING) || {_NL} || '    steps:' || {_NL} || '      - run: make' || {_NL})"
AFTER = (
    f"(CASE WHEN k = 40 THEN 'a: [' WHEN k % 6 = 0 THEN {_READ} WHEN k % 6 = 1 THEN {_PINNED(BEFORE)} "
    f"WHEN k % 6 = 2 THEN replace({_PINNED(_READ)}, '  ' || {JOB} || ':', '  z:') WHEN k % 6 = 3 THEN {_OTHER('write-all')} "
    f"WHEN k % 6 = 5 THEN {_OTHER('read-all')} WHEN floor(k / 6) % 2 = 1 THEN {BEFORE} || 'debug: true' || {_NL} ELSE {BEFORE} || 'name: x' || {_NL} END)"
)
#: Files of commits, for DuckDB.
FILES = """
f AS (
  SELECT *, k % 6 AS t, floor(k / 6)::INT AS v, 'j' || (k % 4) AS j FROM (
    SELECT o_orderkey AS o, o_custkey % 50 AS n, o_orderdate AS d, 'f.yml' AS file, o_orderkey % 42 AS k FROM orders
    UNION ALL SELECT o_orderkey, o_custkey % 50, o_orderdate, 'g.yml', (o_orderkey + 1) % 42 FROM orders WHERE o_orderkey % 3 = 0)),
c AS (
  SELECT o, n, d, bool_and(k = 40) AS unread, bool_or(t IN (0, 2, 5)) AS perm, bool_or(t IN (1, 2, 3, 5)) AS pin, bool_or(t = 4 AND k <> 40 AND v % 2 = 1) AS worse,
         bool_or(file = 'f.yml' AND t <> 4) AS ff, bool_or(file = 'g.yml' AND t <> 4) AS gf,
         CASE WHEN bool_and(t NOT IN (3, 5)) THEN 'structural' WHEN bool_and(t = 3) THEN 'deletion' ELSE 'mixed' END AS kind,
         CASE WHEN n % 10 = 9 THEN 'repo_error' WHEN o % 7 = 0 THEN 'not_on_default' WHEN n % 10 = 8 THEN 'branches_error' ELSE 'ok' END AS status
  FROM f GROUP BY o, n, d),
clean AS (SELECT *, concat_ws(',', CASE WHEN perm THEN 'perm' END, CASE WHEN pin THEN 'pin' END) AS fixes FROM c WHERE (perm OR pin) AND NOT worse)"""
#: What each path of each file became, for DuckDB; needs FILES.
CHANGES = """
ch AS (
  SELECT o, file, 'permissions' AS path, 'changed' AS change, 'write-all' AS old, 'read-all' AS new FROM f WHERE t IN (0, 2, 5)
  UNION ALL SELECT o, file, 'permissions', 'removed', 'write-all', NULL FROM f WHERE k = 40
  UNION ALL SELECT o, file, 'jobs.' || j || '.steps[uses=acme/fetch~0].uses', 'changed', 'acme/fetch@v' || (k % 3), 'acme/fetch@' || repeat('1', 40) FROM f WHERE t = 1
  UNION ALL SELECT o, file, 'jobs.' || j || u.p, 'removed', u.v, NULL FROM (
    SELECT *, unnest([{'p': '.runs-on', 'v': 'n' || k}, {'p': '.steps[uses=acme/fetch~0].uses', 'v': 'acme/fetch@v' || (k % 3)}, {'p': '.steps[run~0].run', 'v': 'make'}]) AS u FROM f WHERE t IN (2, 3, 5) OR k = 40)
  UNION ALL SELECT o, file, 'jobs.z' || u.p, 'added', NULL, u.v FROM (
    SELECT *, unnest([{'p': '.runs-on', 'v': 'n' || k}, {'p': '.steps[uses=acme/fetch~0].uses', 'v': 'acme/fetch@' || repeat('1', 40)}, {'p': '.steps[run~0].run', 'v': 'make'}]) AS u FROM f WHERE t = 2)
  UNION ALL SELECT o, file, 'jobs.other' || u.p, 'added', NULL, u.v FROM (
    SELECT *, unnest([{'p': '.runs-on', 'v': 'n' || k}, {'p': '.steps[run~0].run', 'v': 'make'}]) AS u FROM f WHERE t IN (3, 5))
  UNION ALL SELECT o, file, CASE WHEN v % 2 = 1 THEN 'debug' ELSE 'name' END, 'added', NULL, CASE WHEN v % 2 = 1 THEN 'True' ELSE 'x' END FROM f WHERE t = 4 AND k <> 40)"""
#: Verdicts of release branches and histories of fixed ones, for DuckDB; needs FILES.
AUDITS = """
au AS (
  SELECT clean.*, branch, CASE
           WHEN branch = 'v2' THEN CASE WHEN ff THEN 'already_fixed' ELSE 'inapplicable' END
           WHEN NOT ff OR n % 4 = 1 THEN 'inapplicable' WHEN n % 4 = 0 OR n % 4 = 2 AND pin THEN 'gap' ELSE 'already_fixed' END AS verdict,
         CASE WHEN branch = 'release/1.x' AND ff AND n % 4 = 3 THEN 1 ELSE 0 END AS n_scan_failed,
         CASE WHEN branch = 'v2' OR NOT ff OR n % 4 IN (1, 3) THEN '' WHEN n % 4 = 0 THEN fixes WHEN pin THEN 'pin' ELSE '' END AS idents
  FROM clean, (SELECT unnest(['release/1.x', 'v2']) AS branch) WHERE status = 'ok'),
hi AS (
  SELECT au.*, path, branch = 'v2' AND path = 'f.yml' AND n % 3 <> 2 AS known FROM au, (SELECT unnest(['f.yml', 'g.yml']) AS path)
  WHERE verdict = 'already_fixed' AND CASE WHEN path = 'f.yml' THEN ff ELSE gf END),
hs AS (
  SELECT *, CASE WHEN known AND n % 3 = 0 THEN 'confirmed_backport' WHEN known THEN 'never_had_it' ELSE 'inconclusive' END AS raw,
         CASE WHEN NOT known THEN 'no_scannable_history' END AS reason, CASE WHEN known AND n % 3 = 0 THEN 's1' END AS version, CASE WHEN known THEN 3 ELSE 0 END AS n_read,
         CASE WHEN known AND n % 3 = 0 THEN (epoch_us(TIMESTAMP '1995-06-01' + to_days(n::INT)) - epoch_us(d)) / 86400000000.0::DOUBLE END AS lag FROM hi),
hr AS (
  SELECT *, CASE WHEN raw <> 'confirmed_backport' THEN raw WHEN lag > 1 THEN 'true_backport' WHEN lag < -1 THEN 'independent_prior_fix' ELSE 'same_day_fix' END AS refined FROM hs)"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit index: the files of FILES, and one added file for every fifth commit, which no filter keeps."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    row = lambda path, k, kind: F.struct(F.lit(path).alias("file_path"), (k % PAIRS).alias("k"), F.lit(kind).alias("git_change_type"))
    o = F.col("o_orderkey")
    files = F.filter(F.array(row("f.yml", o, "M"), F.when(o % 3 == 0, row("g.yml", o + 1, "M")), F.when(o % 5 == 0, row("h.yml", o, "A"))), lambda x: x.isNotNull())
    rows = orders.withColumn("_f", F.explode(files))
    yes = F.lit("True")
    return rows.select(
        F.concat(F.lit("r"), F.col("o_custkey") % REPOS).alias("repository"), F.concat(F.lit("c"), o).alias("commit_hash"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("committed_date"),
        F.col("_f.file_path").alias("file_path"), F.concat(F.lit("a"), "_f.k").alias("file_hash"), F.concat(F.lit("b"), "_f.k").alias("previous_file_hash"),
        F.col("_f.git_change_type").alias("git_change_type"), yes.alias("valid_yaml"), yes.alias("valid_workflow"), yes.alias("probably_workflow"),
    )


def blobs(spark: SparkSession) -> DataFrame:
    """(file_hash, text, content, findings, ok) of both versions of all pairs."""
    pairs = spark.range(PAIRS).withColumnRenamed("id", "k")
    finding = lambda ident, route: f"named_struct('ident', '{ident}', 'severity', '', 'confidence', '', 'route', {route})"
    pin = f"'jobs.' || {JOB} || '.steps[0].uses'"
    perm, pinned, debug = finding("perm", "'permissions'"), finding("pin", pin), finding("dbg", "'debug'")
    sides = {
        "b": (BEFORE, f"array({perm}, {pinned})", "true"),
        "a": (AFTER, f"filter(array(CASE WHEN k % 6 IN (1, 3, 4) THEN {perm} END, CASE WHEN k % 6 IN (0, 4) THEN {pinned} END, CASE WHEN k % 6 = 4 AND floor(k / 6) % 2 = 1 THEN {debug} END), x -> x IS NOT NULL)", "k <> 40"),
    }
    parts = [pairs.selectExpr(f"'{s}' || CAST(k AS STRING) AS file_hash", f"{text} AS text", f"encode({text}, 'UTF-8') AS content", f"CASE WHEN {ok} THEN {found} END AS findings", f"{ok} AS ok") for s, (text, found, ok) in sides.items()]
    return parts[0].unionAll(parts[1])


def scans(spark: SparkSession) -> DataFrame:
    return blobs(spark).select("file_hash", "ok", F.when(~F.col("ok"), "can't be read").alias("error"), "findings")


def check(content: bytes) -> list[dict]:
    """The scanner of this world."""
    text = content.decode()
    if text.startswith("a: ["):
        raise ValueError("can't be read")
    found = [{"ident": "perm", "route": "permissions"}] if "permissions: write-all" in text else []
    found += [{"ident": "pin", "route": f"jobs.{j}.steps[0].uses"} for j in re.findall(r"^  (\w+):\n    runs-on: n\d+\n    steps:\n      - uses: acme/fetch@v", text, re.M)]
    return found + ([{"ident": "dbg", "route": "debug"}] if "debug: true" in text else [])


def forge(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What the forge knows: repositories, branches, ancestry, files at heads and versions, histories, commits."""
    n, name = F.col("n"), F.concat(F.lit("r"), F.col("n")).alias("repository")
    repos = spark.range(REPOS).withColumnRenamed("id", "n")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % REPOS).alias("n"), "o_orderdate")
    commit = F.concat(F.lit("c"), F.col("o_orderkey"))
    texts = blobs(spark).select(F.col("file_hash").alias("blob_sha"), "content")

    def at(ref: str, blob: F.Column, missing: F.Column) -> DataFrame:
        return repos.select(name, F.lit(ref).alias("ref"), F.lit("f.yml").alias("path"), F.when(~missing, blob).alias("blob_sha"), missing.alias("missing"))

    head = F.when(n % 4 == 0, F.concat(F.lit("b"), n % PAIRS)).when(n % 4 == 2, "a0").otherwise("a40")
    refs = at("release/1.x", head, n % 4 == 1).unionAll(at("v2", F.lit("a2"), F.lit(False)))
    for i in range(3):
        refs = refs.unionAll(at(f"s{i}", F.when((n % 3 == 0) & (F.lit(i) == 2), "b0").otherwise("a2"), n % 3 == 2))
    days = F.array(F.lit("1995-12-01 00:00:00"), F.date_format(F.lit("1995-06-01").cast("date") + n.cast("int"), "yyyy-MM-dd HH:mm:ss"), F.lit("1992-01-01 00:00:00"))
    walk = repos.select("n", F.posexplode(days).alias("seq", "at"))
    return {
        "repos": repos.filter(n % 10 != 9).select(name, F.lit("main").alias("default_branch")),
        "branches": repos.filter(n % 10 != 8).select(name, F.explode(F.array(*[F.lit(b) for b in ("main", "release/1.x", "v2", "feature/x")])).alias("branch"), F.lit("h").alias("head_sha")),
        "commit_on_branch": orders.select(name, F.lit("main").alias("branch"), commit.alias("commit_hash"), (F.col("o_orderkey") % 7 != 0).alias("reachable")),
        "file_at_ref": refs.join(texts, "blob_sha", "left").select("repository", "ref", "path", "content", "blob_sha", "missing"),
        "file_history": walk.select(name, F.lit("v2").alias("branch"), F.lit("f.yml").alias("path"), "seq", F.concat(F.lit("s"), "seq").alias("commit_sha"), F.col("at").alias("committed_at")),
        "commit_info": orders.select(name, commit.alias("commit_sha"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("committed_at"), F.lit("p").alias("parent_sha")).unionAll(
            walk.select(name, F.concat(F.lit("s"), "seq"), F.col("at"), F.concat(F.lit("s"), F.col("seq") + 1))
        ),
    }


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])
