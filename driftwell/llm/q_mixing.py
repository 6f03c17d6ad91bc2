"""Query and SQL of the mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .mixing import BLOCK, SEED, SHARD_WORDS, mix_documents


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).drop("source")


def _h(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


def _apportion(name: str, rows: str, group: str, party: str) -> str:
    """CTEs that deal seats by ranking every quotient of every party: the plain definition."""
    return f"""
{name}_q AS (
  SELECT {group} AS g, {party} AS party, votes / (2 * k + 1) AS q, k, seats
  FROM (SELECT *, unnest(range(0, cap::BIGINT)) AS k FROM {rows}) WHERE votes > 0),
{name} AS (
  SELECT g, party, count(*) AS quota FROM (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY q DESC, party NULLS LAST, k) AS r FROM {name}_q) WHERE r <= seats
  GROUP BY g, party)"""


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         {_h(f"'{SEED}:doc:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))")} AS draw
  FROM documents),
s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM s0),
s2 AS (
  SELECT *, [3, 1, 2][((rn - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM s1),
s3 AS (
  SELECT *, cap / weight AS ratio, 1.5 * sum(source_size) OVER () AS budget FROM s2),
s4 AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s3),
s5 AS (
  SELECT *, least(cap::DOUBLE, weight * (SELECT arg_min(lev, (ratio, rn)) FROM s4 WHERE lev <= ratio))::DOUBLE AS target FROM s4),
sv AS (
  SELECT 1 AS one, source, target AS votes, ceil(source_size / {BLOCK}) * 2 AS cap, round((SELECT sum(target) FROM s5) / {BLOCK}) AS seats FROM s5),
{_apportion("sq", "sv", "one", "source")},
p AS (
  SELECT d.*, source_size, target, coalesce(quota, 0) AS blocks,
         draw % greatest(ceil(source_size / {SHARD_WORDS}), 1)::BIGINT AS shard,
         CASE WHEN d.source IS NULL THEN '0' ELSE '1' || d.source END AS name
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source LEFT JOIN sq ON d.source IS NOT DISTINCT FROM sq.party),
pp AS (
  SELECT *, (sum(size) OVER (PARTITION BY name, shard ORDER BY draw, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS s FROM p),
h AS (
  SELECT name, shard, sum(size)::DOUBLE AS votes, ceil(sum(size) / {BLOCK})::BIGINT AS n, 2 * ceil(sum(size) / {BLOCK}) AS cap, any_value(blocks) AS seats
  FROM pp GROUP BY name, shard),
{_apportion("hq", "h", "name", "shard")},
b AS (
  SELECT name, shard, n, coalesce(quota, 0) AS quota, unnest(range(0, n)) AS block
  FROM h LEFT JOIN hq ON hq.g = name AND hq.party = shard WHERE n > 0),
pick AS (
  SELECT *, quota // n + CASE WHEN row_number() OVER (
    PARTITION BY name, shard ORDER BY {_h(f"'{SEED}:block:' || name || ':' || shard || ':' || block")}, block) <= quota % n THEN 1 ELSE 0 END AS times
  FROM b),
t AS (
  SELECT pp.name, pp.shard, pp.s, pp.size, sum((least(s + size, (block + 1) * {BLOCK}) - greatest(s, block * {BLOCK})) * times)::BIGINT AS taken
  FROM pp JOIN pick ON pp.name = pick.name AND pp.shard = pick.shard AND block BETWEEN s // {BLOCK} AND (s + size - 1) // {BLOCK}
  WHERE size > 0 GROUP BY pp.name, pp.shard, pp.s, pp.size)
SELECT doc_id, pp.size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM pp LEFT JOIN t ON pp.name = t.name AND pp.shard = t.shard AND pp.s = t.s AND pp.size = t.size
"""

QUERIES = {"op4_mixing": op4_mixing}
ORACLE_SQL = {"op4_mixing": SQL}
