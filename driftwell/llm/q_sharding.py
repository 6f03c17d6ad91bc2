"""Query and SQL of the sharding operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .sharding import CHUNKS, SEED, shard_documents


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def _h(name: str, key: str = "k") -> str:
    return f"('0x' || substr(md5('{name}' || {key}), 1, 13))::BIGINT"


def _d(name: str, weight: int) -> str:
    return f"ln(({_h(f'{SEED}:{name}:')} + 0.5) / 4503599627370496.0) / {weight}"


def _rack(r: int, k: int) -> str:
    a = r * 4 + k * 2
    return f"CASE WHEN {_d(f's{a}', 1)} >= {_d(f's{a + 1}', 1)} THEN {a} ELSE {a + 1} END"


def _region(r: int) -> str:
    return f"CASE WHEN {_d(f'r{r}k0', 2)} >= {_d(f'r{r}k1', 2)} THEN {_rack(r, 0)} ELSE {_rack(r, 1)} END"


#: CRC-32 by its table, made of eight shift steps; the text's bytes are read from its hexadecimal form.
_STEP = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"

SQL = f"""
WITH RECURSIVE step(i, c, n) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, {_STEP.format(c="c")}, n + 1 FROM step WHERE n < 8),
tab AS (SELECT list(c ORDER BY i) AS crc FROM step WHERE n = 8),
d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS t FROM documents),
texts AS (SELECT DISTINCT t FROM d),
bytes AS (
  SELECT t, CASE WHEN t = '' THEN 0 ELSE xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda b: ('0x' || b)::BIGINT)),
      lambda c, b: xor(c >> 8, crc[((xor(c, b)) & 255) + 1])), 4294967295) END AS crc
  FROM texts, tab),
p AS (
  SELECT doc_id, k, octet_length(encode(t)) + 1 AS size, crc,
         CASE WHEN {_d("r0", 4)} >= {_d("r1", 4)} THEN {_region(0)} ELSE {_region(1)} END AS shard,
         {_d("r2", 1)} > greatest({_d("r0", 4)}, {_d("r1", 4)}) AS moves,
         {_h("slot:", "k || ':' || (octet_length(encode(t)) + 1) || ':' || crc")} % {CHUNKS} AS chunk
  FROM d JOIN bytes USING (t))
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY chunk, doc_id NULLS LAST, size, crc) - 1 AS slot,
       (CASE WHEN moves THEN 8 ELSE shard END)::INTEGER AS grown_shard
FROM p
"""

QUERIES = {"op3_sharding": op3_sharding}
ORACLE_SQL = {"op3_sharding": SQL}
