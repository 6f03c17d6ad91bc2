"""Query and SQL of exact top-k search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .bitslice import top_inner_products
from .common import table


def op1_bitslice_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


SQL = """
WITH v AS (
  SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.id AS query_id, c.id AS vec_id,
         coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM v q, v c WHERE q.id % 100 = 0 AND q.id <> c.id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op1_bitslice_topk": op1_bitslice_topk}
ORACLE_SQL = {"op1_bitslice_topk": SQL}
