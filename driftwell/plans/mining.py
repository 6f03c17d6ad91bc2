"""Sampling, differences, clean fixes, clusters and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import clusters, diffs, sampling
from ..operators.lineage import settle
from .tables import order_lines, table, user_day_changes

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT o_orderkey, sha256('42:' || o_orderkey) AS sample_hash FROM orders
ORDER BY sample_hash, o_orderkey LIMIT 500""")
def hash_sample_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500)


@query("""
WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('42:' || o_orderkey), o_orderkey) AS r FROM orders)
SELECT count(*) FILTER (r <= 100) AS n_small, count(*) FILTER (r <= 100 AND r > 500) AS n_missing FROM h""")
def hash_sample_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    small, large = (sampling.hash_sample(orders, "o_orderkey", n) for n in (100, 500))
    missing = small.join(large.select("o_orderkey", F.lit(1).alias("_in")), "o_orderkey", "left")
    return missing.agg(F.count("*").alias("n_small"), F.count_if(F.col("_in").isNull()).alias("n_missing"))


@query("""
WITH taken AS (SELECT o_orderkey FROM orders ORDER BY sha256('42:' || o_orderkey), o_orderkey LIMIT 500)
SELECT o_orderkey, sha256('99:' || o_orderkey) AS sample_hash FROM orders WHERE o_orderkey NOT IN (FROM taken)
ORDER BY sample_hash, o_orderkey LIMIT 200""")
def hash_sample_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return sampling.hash_sample(orders, "o_orderkey", 200, seed=99, exclude=sampling.hash_sample(orders, "o_orderkey", 500))


@query("""
SELECT l_orderkey, min(l_shipdate)::VARCHAR AS first_date, count(*) AS n_files,
       string_agg(l_linenumber || '/' || l_partkey || '/' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS files
FROM lineitem GROUP BY l_orderkey""")
def commit_file_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")]
    rolled = sampling.roll_up(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_shipdate", items)
    names = F.transform("files", lambda f: F.concat_ws("/", *[f[c].cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")]))
    return rolled.select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("first_date"), F.size("files").cast("long").alias("n_files"), F.array_join(names, ",").alias("files"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 10 AND l_partkey IS NOT NULL AND l_suppkey IS NOT NULL""")
def valid_modification_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    kept = lines.filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 10) & F.col("l_partkey").isNotNull() & F.col("l_suppkey").isNotNull())
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


CHANGES = """
WITH f AS (SELECT DISTINCT user_id, ts::DATE::VARCHAR AS day, event_type AS ident FROM events),
d AS (SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS before FROM (SELECT DISTINCT user_id, day FROM f)),
c AS (
  SELECT d.user_id, d.day, b.ident, 'fixed' AS side FROM d JOIN f b ON b.user_id = d.user_id AND b.day = d.before
  WHERE NOT EXISTS (FROM f a WHERE a.user_id = d.user_id AND a.day = d.day AND a.ident = b.ident)
  UNION ALL
  SELECT d.user_id, d.day, a.ident, 'introduced' FROM d JOIN f a ON a.user_id = d.user_id AND a.day = d.day
  WHERE d.before IS NOT NULL AND NOT EXISTS (FROM f b WHERE b.user_id = d.user_id AND b.day = d.before AND b.ident = a.ident))
"""


@query(CHANGES + "SELECT user_id, day, ident, side FROM c")
def findings_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day_changes(spark, sf_dir)


@query(CHANGES + """
SELECT user_id, day, count(*) AS n_fixed, string_agg(ident, ',' ORDER BY ident) AS fixes
FROM c GROUP BY user_id, day HAVING count(*) FILTER (side = 'introduced') = 0""")
def clean_fix_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_day = user_day_changes(spark, sf_dir).groupBy("user_id", "day").agg(F.count_if(F.col("side") == "introduced").alias("_i"), F.count("*").alias("n_fixed"), F.array_join(F.array_sort(F.collect_set("ident")), ",").alias("fixes"))
    return by_day.filter("_i = 0").drop("_i")


@query(CHANGES + """,
k AS (SELECT user_id, day, ident, count(*) FILTER (side = 'fixed') AS f, count(*) FILTER (side = 'introduced') AS i FROM c GROUP BY ALL),
v AS (SELECT user_id, sum(f) > 0 AS fixed, sum(i) = 0 AS none, bool_and(i = 0 OR f > 0) AS a, bool_and(i <= f) AS b FROM k GROUP BY user_id, day)
SELECT count(*) FILTER (fixed AND none) AS strict, count(*) FILTER (fixed AND a) AS loose_a, count(*) FILTER (fixed AND b) AS loose_b, count(*) FILTER (fixed) AS loose_c FROM v""")
def clean_fix_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = diffs.fix_variants(user_day_changes(spark, sf_dir), ["user_id", "day"])
    return held.agg(*[F.count_if(c).alias(c) for c in ("strict", "loose_a", "loose_b", "loose_c")])


@query("""
WITH p AS (
  SELECT o_custkey AS c, o_orderkey AS o, l_returnflag || l_linestatus AS path, count(*) AS leaf
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
v AS (SELECT c, o, lag(o) OVER (PARTITION BY c ORDER BY o) AS b FROM (SELECT DISTINCT c, o FROM p)),
old AS (SELECT v.c, v.o, path, leaf FROM v JOIN p ON p.c = v.c AND p.o = v.b),
new AS (SELECT v.c, v.o, path, leaf FROM v JOIN p ON p.c = v.c AND p.o = v.o WHERE b IS NOT NULL)
SELECT coalesce(old.c, new.c) AS o_custkey, coalesce(old.o, new.o) AS o_orderkey, coalesce(old.path, new.path) AS path,
       CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' ELSE 'changed' END AS change, old.leaf::VARCHAR AS old, new.leaf::VARCHAR AS new
FROM old FULL JOIN new ON old.c = new.c AND old.o = new.o AND old.path = new.path WHERE old.leaf IS DISTINCT FROM new.leaf""")
def pathmap_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.concat("l_returnflag", "l_linestatus").alias("path")).agg(F.count("*").cast("string").alias("leaf"))
    facts = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return diffs.path_changes(diffs.consecutive_sides(facts, ["o_custkey"], "o_orderkey"), ["o_custkey", "o_orderkey"])


LINES = """
WITH l AS (SELECT l_orderkey AS o, p_brand AS brand, p_brand || '|' || l_returnflag AS line FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (
  SELECT o, string_agg(DISTINCT brand, ',' ORDER BY brand) AS fixes, sha256(string_agg(line, chr(10) ORDER BY line) || chr(10)) AS template_hash
  FROM l GROUP BY o)
"""


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = order_lines(spark, sf_dir)
    # One grouping gives both keys of an order.
    rows = lines.groupBy("o").agg(F.collect_set("p_brand").alias("_b"), F.array_sort(F.collect_list(F.concat_ws("|", "p_brand", "l_returnflag"))).alias("_l"))
    return rows.select("o", clusters.set_key(F.col("_b")).alias("fixes"), clusters.template_digest(F.col("_l")).alias("template_hash"))


@query(LINES + "SELECT fixes, template_hash, count(*) AS n_commits, min(o) AS first_commit FROM t GROUP BY fixes, template_hash")
def two_level_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.cluster(_commits(spark, sf_dir), order=["o"])
    return found.select("fixes", "template_hash", "n_commits", F.col("exemplars")[0]["o"].alias("first_commit"))


@query(LINES + "SELECT fixes, count(*) AS n_commits, count(DISTINCT template_hash) AS n_subclusters FROM t GROUP BY fixes")
def cluster_level_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.level_one(_commits(spark, sf_dir))


@query(LINES + """
SELECT fixes, template_hash, o, exemplar FROM (
  SELECT *, row_number() OVER (PARTITION BY fixes, template_hash ORDER BY o) AS exemplar FROM t) WHERE exemplar <= 5""")
def cluster_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.first_of_each(_commits(spark, sf_dir), ["fixes", "template_hash"], ["o"])


@query(LINES + """
SELECT o, CASE WHEN (fixes, template_hash) IN (SELECT (fixes, template_hash) FROM t WHERE o % 2 = 0) THEN 'full'
               WHEN fixes IN (SELECT fixes FROM t WHERE o % 2 = 0) THEN 'level-1' ELSE 'miss' END AS outcome
FROM t WHERE o % 2 = 1""")
def catalog_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = settle(_commits(spark, sf_dir))  # read four times
    return clusters.match_catalog(commits.filter("o % 2 = 1"), commits.filter("o % 2 = 0")).select("o", "outcome")


@query("""
SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey, l_suppkey, row_number() OVER (
  PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate) - 1 AS occurrence
FROM lineitem""")
def occurrence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]
    found = diffs.occurrence_index(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], order)
    return found.select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "occurrence")


@query("""
SELECT d.doc_id, l.quality::VARCHAR AS quality, n.quality::VARCHAR AS next_quality,
       CASE WHEN l.doc_id IS NULL OR n.doc_id IS NULL THEN 'incomplete' ELSE 'ok' END AS scan_status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN labels n ON d.doc_id + 1 = n.doc_id""")
def scan_left_join_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_hash"), (F.col("doc_id") + 1).alias("previous_file_hash"))
    scans = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_hash"), F.lit(True).alias("ok"), F.col("quality").cast("string").alias("findings"))
    met = diffs.join_scans(docs, scans)
    return met.select(F.col("file_hash").alias("doc_id"), F.col("after").alias("quality"), F.col("before").alias("next_quality"), "scan_status")


@query("""
SELECT sha256(text) AS digest, count(*) AS n_sides FROM (
  SELECT DISTINCT text, 1 AS s FROM documents UNION ALL SELECT DISTINCT text, 2 FROM benchmark) GROUP BY text""")
def distinct_hash_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [table(spark, sf_dir, t).select(F.sha2("text", 256).alias("digest"), F.lit(s).alias("_s")) for t, s in (("documents", 1), ("benchmark", 2))]
    pairs = sides[0].unionAll(sides[1]).groupBy("digest").agg((F.max(F.when(F.col("_s") == 1, 1).otherwise(0)) + F.max(F.when(F.col("_s") == 2, 1).otherwise(0))).cast("long").alias("n_sides"))
    return pairs
