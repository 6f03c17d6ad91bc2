"""Query and SQL of conversation repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .conversation import conversation_digests, repair, repaired

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: a row's kind follows from conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), h.alias("h")).filter("h != 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    told, ordered = repair(rows)
    digests = conversation_digests(repaired(rows, told, ordered)).withColumnRenamed("conv_id", "c")
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    joined = ids.join(told, F.col("conv_id").eqNullSafe(F.col("id")), "left").join(digests, F.col("c").eqNullSafe(F.col("id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(EMPTY)).alias("repaired_sha256"))


#: Cheapest path turn by turn; states: 0 nothing yet, 1 after s, 2 after u, 3 after a.
SQL = """
WITH RECURSIVE step(i, c, n) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM step WHERE n < 8),
tab AS (SELECT list(c ORDER BY i) AS crc FROM step WHERE n = 8),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda b: ('0x' || b)::BIGINT)),
             lambda c, b: xor(c >> 8, crc[((xor(c, b)) & 255) + 1])), 4294967295) % 20 AS h
  FROM conversations, tab),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE h != 0),
numbered AS (SELECT *, row_number() OVER () AS id FROM damaged),
placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id) > 1 AS later,
         lag(left(role, 1)) OVER w AS before
  FROM numbered WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, id)),
judged AS (
  SELECT *, left(role, 1) AS r,
         CASE WHEN trim(text, e' \\t\\n\\x0b\\x0c\\r') = '' THEN 'blank' WHEN later THEN 'duplicate' WHEN right(rtrim(text, e' \\t\\n\\x0b\\x0c\\r'), 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM placed),
counted AS (
  SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id),
inserts(f, t, c, a, o) AS (
  VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']),
         (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
moves(f, r, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
edits AS (
  SELECT conv_id, i, f, f AS t, 3 AS c, 'D' AS a, []::VARCHAR[] AS o FROM judged, range(4) s(f)
  UNION ALL
  SELECT conv_id, i, f, t, (fault IS NOT NULL)::INT, 'K', [role || ':' || text] FROM judged JOIN moves USING (r) WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL
  SELECT conv_id, i, f, t, 2 + (fault IS NOT NULL)::INT, 'R', [CASE m.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM judged j, moves m
  WHERE m.r != 's' AND (fault IS NULL OR fault = 'truncated')),
paths AS (
  SELECT conv_id, 0 AS i, 0 AS s, 0 AS c, '' AS a, []::VARCHAR[] AS o FROM counted
  UNION ALL
  SELECT conv_id, i, s, best.c, best.a, best.o
  FROM (SELECT p.conv_id, p.i + 1 AS i, e.t AS s, min({'c': p.c + n.c + e.c, 'a': p.a || n.a || e.a, 'o': p.o || n.o || e.o}) AS best
        FROM paths p JOIN inserts n ON n.f = p.s JOIN edits e ON e.f = n.t AND e.i = p.i + 1 AND e.conv_id IS NOT DISTINCT FROM p.conv_id
        GROUP BY ALL)),
ends AS (
  SELECT q.conv_id, min({'c': p.c + n.c, 'a': p.a || n.a, 'o': p.o || n.o}) AS best
  FROM counted q JOIN paths p ON p.i = q.n AND p.conv_id IS NOT DISTINCT FROM q.conv_id JOIN inserts n ON n.f = p.s
  WHERE n.t IN (0, 3) GROUP BY q.conv_id)
SELECT id AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id AS id FROM conversations)
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM id
"""

QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLE_SQL = {"op13_conversation_repair": SQL}
