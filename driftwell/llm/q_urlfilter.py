"""Query and SQL of the URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .urlfilter import DEPTH, PRIOR, RULES, SHARE, STRENGTH, THRESHOLD, VARIABLE, VARIETY, Z, filter_urls


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("template", "purity")


def _rules() -> tuple[str, str]:
    rule, verdict = [], []
    for v, r in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = r.partition("/")
        fit = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')"
        rule.append(f"WHEN {fit} THEN '{r}'")
        verdict.append(f"WHEN {fit} THEN '{v}'")
    return f"CASE {' '.join(rule)} END", f"CASE {' '.join(verdict)} END"


def _node_level(level: int) -> str:
    """One level of generalise(): g{level} from g{level - 1}."""
    before = f"g{level - 1}"
    return f"""
k{level} AS (
  SELECT host, node, lexical[{level}] AS seg, sum(pages) AS pages FROM {before} WHERE len(lexical) >= {level} GROUP BY ALL),
v{level} AS (
  SELECT host, node FROM k{level} GROUP BY host, node HAVING count(*) >= {VARIETY} AND count(*) > {SHARE} * sum(pages)),
g{level} AS (
  SELECT g.* EXCLUDE (node), CASE WHEN len(lexical) < {level} THEN g.node WHEN v.host IS NOT NULL THEN g.node || '/*' ELSE g.node || '/' || lexical[{level}] END AS node
  FROM {before} g LEFT JOIN v{level} v ON g.host = v.host AND g.node = v.node)"""


def _branch_level(level: int) -> str:
    """One level of judge_templates(): b{level} from b{level - 1}."""
    before = f"b{level - 1}"
    return f"""
s{level} AS (
  SELECT host, branch, parts[{level + 1}] AS child, sum(allowed) AS a, sum(blocked) AS b, any_value(purity) AS above
  FROM {before} WHERE len(parts) > {level} GROUP BY ALL),
n{level} AS (
  SELECT *, CASE WHEN pow(b - (a + b) * above, 2) > {Z * Z} * (a + b) * above * (1 - above) THEN child ELSE '~' END AS name FROM s{level}),
m{level} AS (
  SELECT host, branch, name, (sum(b) + {STRENGTH} * any_value(above)) / (sum(a) + sum(b) + {STRENGTH}) AS purity FROM n{level} GROUP BY host, branch, name),
b{level} AS (
  SELECT r.* EXCLUDE (branch, purity), coalesce(m.purity, r.purity) AS purity, r.branch || coalesce('/' || n.name, '') AS branch
  FROM {before} r LEFT JOIN n{level} n ON r.host = n.host AND r.branch = n.branch AND r.parts[{level + 1}] = n.child
  LEFT JOIN m{level} m ON n.host = m.host AND n.branch = m.branch AND n.name = m.name)"""


_RULE, _VERDICT = _rules()
LEVELS = DEPTH + 1
SQL = rf"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r AS (
  SELECT *, {_RULE} AS rule, {_VERDICT} AS ruled,
         list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s: CASE WHEN regexp_matches(s, '{VARIABLE}') THEN '*' ELSE s END) AS parts
  FROM p),
t AS (
  SELECT *, CASE WHEN len(parts) > {DEPTH} THEN list_append(parts[1:{DEPTH}], '**') ELSE parts END AS lexical FROM r),
g0 AS (
  SELECT host, lexical, '' AS node, count(*) AS pages, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked
  FROM t GROUP BY host, lexical),
{",".join(_node_level(i) for i in range(1, LEVELS + 1))},
c AS (
  SELECT host, node, sum(allowed) AS allowed, sum(blocked) AS blocked FROM g{LEVELS} GROUP BY host, node),
root AS (
  SELECT (sum(blocked) + {STRENGTH * PRIOR}) / (sum(allowed) + sum(blocked) + {STRENGTH}) AS purity FROM c),
h AS (
  SELECT host, (sum(blocked) + {STRENGTH} * any_value(root.purity)) / (sum(allowed) + sum(blocked) + {STRENGTH}) AS purity FROM c, root GROUP BY host),
b0 AS (
  SELECT c.*, string_split(node, '/') AS parts, h.purity, '' AS branch FROM c JOIN h USING (host)),
{",".join(_branch_level(i) for i in range(1, LEVELS + 1))}
SELECT page_id, t.host, path, rule, coalesce(ruled, CASE WHEN b.purity > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM t JOIN g{LEVELS} g ON t.host = g.host AND t.lexical = g.lexical JOIN b{LEVELS} b ON g.host = b.host AND g.node = b.node
"""

QUERIES = {"op7_url_filter": op7_url_filter}
ORACLE_SQL = {"op7_url_filter": SQL}
