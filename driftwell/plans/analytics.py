"""Cross-tabulations, shares, routes, sketches and oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import PATH_FORMS, SHA, TAG, cache_key, flat_file_name, generalise_path, pinned_hashes, scope_of_route, shard_path, value_sketch
from ..operators import clusters, reports, scopes
from .mining import LINES, _commits
from .tables import order_lines, table

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
WITH r AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT x.b AS a, y.b AS b, count(*) AS n FROM r x JOIN r y ON x.o = y.o AND x.b < y.b GROUP BY x.b, y.b""")
def rule_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.co_occurrence(order_lines(spark, sf_dir), ["o"], "p_brand")


@query("""
SELECT event_type, count(*) FILTER (value < 10) AS n_low, count(*) FILTER (value >= 10 AND value < 50) AS n_middle, count(*) FILTER (value >= 50) AS n_high
FROM events GROUP BY event_type""")
def rule_status_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "middle").when(F.col("value") >= 50, "high")
    return reports.cross_tab(table(spark, sf_dir, "events").withColumn("status", status), "event_type", "status", ["low", "middle", "high"])


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY o_orderpriority")
def bucket_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.shares(table(spark, sf_dir, "orders"), "o_orderpriority")


@query(LINES + """
, c AS (SELECT fixes, count(*) AS n, count(DISTINCT template_hash) AS k FROM t GROUP BY fixes)
SELECT len(string_split(fixes, ',')) AS set_size, count(*) AS n_patterns, sum(n) AS n_commits, sum(k) AS n_subclusters, round(sum(k) / sum(n), 6) AS uniqueness FROM c GROUP BY 1""")
def catalog_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.catalog_distribution(clusters.level_one(_commits(spark, sf_dir)))


#: Scopes that urls are sought in, in the order in which they win.
SCOPES = ("en/1", "en", "fr", "de", "es", "")


@query(f"""
WITH p AS (SELECT page_id, ltrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') AS route FROM pages),
s AS (SELECT unnest({list(SCOPES)}) AS scope, unnest(range({len(SCOPES)})) AS scope_order)
SELECT page_id, route, scope FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY scope_order) AS r FROM p JOIN s
  ON scope = '' OR route = scope OR starts_with(route, scope || '.') OR starts_with(route, scope || '['))
WHERE r = 1""".replace("starts_with(route, scope || '.')", "starts_with(route, scope || '/')"))
def route_scope_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes are url paths here, so slashes stand for dots."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.ltrim(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), F.lit("/")).alias("_path"))
    routes = pages.select("page_id", F.translate("_path", "./", "\x01.").alias("route"), F.lit(0).alias("k"))
    known = spark.createDataFrame([(0, s.replace("/", "."), i) for i, s in enumerate(SCOPES)], "k int, scope string, scope_order int")
    back = lambda c: F.translate(c, "\x01.", "./")
    return scopes.in_scope(routes, known, ["k"]).select("page_id", back("route").alias("route"), back("scope").alias("scope"))


def _nested(pattern: str) -> str:
    out = pattern
    for form, replacement in PATH_FORMS:
        out = f"regexp_replace({out}, '{form.replace(chr(39), chr(39) * 2)}', '{replacement}', 'g')"
    return out


#: Paths of the forms that generalisation knows, made of an order's columns.
_PATH_SQL = "'jobs.j' || o_custkey || '.steps[' || ['uses=a/b', 'id=i', 'name=n', 'run=ab', '#7', '''s''', '1.5', 'True', '9'][(o_orderkey % 9 + 1)::INT] || '~' || (o_orderkey % 3) || '].with[' || (o_orderkey % 5) || ']'"


@query(f"SELECT path, count(*) AS n FROM (SELECT {_nested(_PATH_SQL)} AS path FROM orders) GROUP BY path")
def path_generalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*[F.lit(x) for x in ("uses=a/b", "id=i", "name=n", "run=ab", "#7", "'s'", "1.5", "True", "9")])
    path = F.concat(F.lit("jobs.j"), "o_custkey", F.lit(".steps["), F.element_at(forms, (F.col("o_orderkey") % 9 + 1).cast("int")), F.lit("~"), F.col("o_orderkey") % 3, F.lit("].with["), F.col("o_orderkey") % 5, F.lit("]"))
    return table(spark, sf_dir, "orders").select(generalise_path(path).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


_LEAF_SQL = "CASE event_id % 8 WHEN 0 THEN 'a/b@' || md5(event_type) || 'abcdef01' WHEN 1 THEN 'a/b@v' || (event_id % 7) WHEN 2 THEN 'a/c@main' WHEN 3 THEN '${{ x }}' WHEN 4 THEN 'write' WHEN 5 THEN event_type WHEN 6 THEN value::INT::VARCHAR ELSE 'x@y' END"


@query(f"""
WITH v AS (SELECT {_LEAF_SQL} AS leaf, CASE event_id % 8 WHEN 6 THEN 'int' ELSE 'str' END AS kind FROM events)
SELECT sketch, count(*) AS n FROM (
  SELECT CASE WHEN kind = 'int' THEN 'num'
              WHEN contains(leaf, '@') AND contains(split_part(leaf, '@', 1), '/') THEN 'uses:' || regexp_extract(leaf, '^(.*)@', 1) || '@<' ||
                CASE WHEN regexp_matches(regexp_extract(leaf, '@([^@]*)$', 1), '{SHA}') THEN 'sha' WHEN regexp_matches(regexp_extract(leaf, '@([^@]*)$', 1), '{TAG}') THEN 'tag' ELSE 'ref' END || '>'
              WHEN contains(leaf, '${{{{') THEN 'expr' WHEN leaf IN ('read', 'write', 'none', 'read-all', 'write-all', 'inherit') THEN 'perm:' || leaf ELSE 'str' END AS sketch FROM v)
GROUP BY sketch""")
def value_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 8
    leaf = (
        F.when(kind == 0, F.concat(F.lit("a/b@"), F.md5("event_type"), F.lit("abcdef01")))
        .when(kind == 1, F.concat(F.lit("a/b@v"), (F.col("event_id") % 7).cast("string")))
        .when(kind == 2, "a/c@main").when(kind == 3, "${{ x }}").when(kind == 4, "write").when(kind == 5, F.col("event_type"))
        .when(kind == 6, F.col("value").cast("int").cast("string")).otherwise("x@y")
    )
    rows = table(spark, sf_dir, "events").select(value_sketch(F.when(kind == 6, "int").otherwise("str"), leaf).alias("sketch"))
    return rows.groupBy("sketch").agg(F.count("*").alias("n"))


@query("SELECT k, count(*) AS n FROM (SELECT json_extract_string(props, '$.k') AS k FROM events) GROUP BY k")
def flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("""
SELECT bucket, count(*) AS n FROM (
  SELECT CASE WHEN l_linenumber = 7 THEN 'fetch_or_compile_error' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'accepted'
              WHEN l_linenumber = 1 AND l_quantity > 25 THEN 'needs_review_only' WHEN l_linenumber = 1 THEN 'no_landed_edits'
              WHEN l_linestatus <> 'O' THEN 'failed_actionlint' WHEN l_returnflag = 'R' THEN 'failed_zizmor_local'
              WHEN l_tax > 0.04 THEN 'regression_in_scope' ELSE 'other' END AS bucket FROM lineitem) GROUP BY bucket""")
def outcome_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    bucket = reports.outcome_bucket(
        F.when(c("l_linenumber") == 7, "target_absent").otherwise("patched"), c("l_returnflag") == "N", c("l_linestatus") == "O",
        c("l_linenumber") - 1, (c("l_quantity") > 25).cast("int"), (c("l_returnflag") == "R").cast("int"), (c("l_tax") > 0.04).cast("int"),
    )
    return table(spark, sf_dir, "lineitem").select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("""
SELECT user_id, event_type AS kind, props AS message FROM events WHERE ts >= TIMESTAMP '2024-01-16'
EXCEPT SELECT user_id, event_type, props FROM events WHERE ts < TIMESTAMP '2024-01-16'""")
def lint_introduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.col("props").alias("message"), "ts")
    at = F.lit("2024-01-16").cast("timestamp_ntz")
    return scopes.lint_introduced(events.filter(F.col("ts") < at), events.filter(F.col("ts") >= at), ["user_id"])


@query("""
SELECT doc_id, k AS key, substr(k, 1, 2) || '/' || substr(k, 3, 2) || '/' || k AS shard, hashes
FROM (SELECT doc_id, substr(sha256(source || chr(0) || doc_id), 1, 32) AS k, len(regexp_extract_all(text, '@([0-9a-f]{40})\\b')) AS hashes FROM documents)""")
def cache_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = cache_key(F.col("source"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), shard_path(key).alias("shard"), F.size(pinned_hashes(F.col("text"))).cast("long").alias("hashes"))


@query(r"""
SELECT page_id, replace(regexp_replace(regexp_replace(url || '.yml', '\.yml$', ''), '\.yaml$', ''), '/', '__') AS name,
       CASE WHEN regexp_matches(r, '^(.*?\.steps\[\d+\])') THEN regexp_extract(r, '^(.*?\.steps\[\d+\])', 1)
            WHEN regexp_matches(r, '^jobs\.[^.\[]+\.services\.[^.\[]+') THEN regexp_extract(r, '^(jobs\.[^.\[]+\.services\.[^.\[]+)', 1)
            WHEN regexp_matches(r, '^jobs\.[^.\[]+') THEN regexp_extract(r, '^(jobs\.[^.\[]+)', 1) ELSE '' END AS scope
FROM (SELECT *, ['jobs.j' || page_id || '.steps[2].run', 'jobs.a.services.db.image', 'jobs.b.permissions', 'permissions.contents', 'jobs.c.steps[11]'][(page_id % 5 + 1)::INT] AS r FROM pages)""")
def route_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(F.concat(F.lit("jobs.j"), F.col("page_id").cast("string"), F.lit(".steps[2].run")), *[F.lit(x) for x in ("jobs.a.services.db.image", "jobs.b.permissions", "permissions.contents", "jobs.c.steps[11]")])
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", flat_file_name(F.concat("url", F.lit(".yml"))).alias("name"), scope_of_route(F.element_at(forms, (F.col("page_id") % 5 + 1).cast("int"))).alias("scope"))
