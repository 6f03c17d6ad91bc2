"""Query and SQL of the WARC archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .warc import round_trip


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = round_trip(table(spark, sf_dir, "pages"), least=0)
    wrong = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("a record read back is wrong: "), "error")))
    return records.select("page_id", F.coalesce(wrong.cast("long"), F.col("payload_bytes")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, upper(sha1(html)) AS hex,
         min(page_id) OVER (PARTITION BY html) AS first
  FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || rpad(substr(hex, (5 * i // 4 + 1)::INT, 2), 2, '0'))::INT >> (3 - 5 * i % 4)::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""

QUERIES = {"op5_warc": op5_warc}
ORACLE_SQL = {"op5_warc": SQL}
