"""Query and SQL of periodic runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import WORD, table
from .periodic import periodic_runs


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; the contract's tenth of the texts get a periodic tail. A null id gives none."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", g.alias("g"), F.when((h % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    rows = rows.withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    tail = F.transform("words", lambda w, i: F.get("words", place(i).cast("int")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    # the longest: greatest length, then smallest start and period
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    rows = found.withColumn("longest", F.array_min(order))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    length, period = -F.col("longest")["l"], F.col("longest")["p"]
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest")["s"].alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: CRC-32 of a decimal number, bit by bit. Scales double names of word sequences: equal names, equal sequences of 2^k words.
SQL = """
WITH RECURSIVE step(i, c, n) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM step WHERE n < 8),
tab AS (SELECT list(c ORDER BY i) AS crc FROM step WHERE n = 8),
docs AS (
  SELECT row_number() OVER () AS d, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda b: ('0x' || b)::BIGINT)),
             lambda c, b: xor(c >> 8, crc[((xor(c, b)) & 255) + 1])), 4294967295) AS h
  FROM documents, tab),
cut AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM docs),
damaged AS (
  SELECT d, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END) + 1]) END AS w
  FROM cut),
words AS MATERIALIZED (
  SELECT d, i, dense_rank() OVER (ORDER BY word) AS name
  FROM (SELECT d, unnest(w) AS word, unnest(range(len(w))) AS i FROM damaged)),
names AS (
  SELECT d, i, name, 1 AS size FROM words
  UNION ALL
  SELECT d, i, dense_rank() OVER (ORDER BY name, next), size * 2
  FROM (SELECT d, i, size, name, lead(name, size::INT) OVER (PARTITION BY d ORDER BY i) AS next FROM names)
  WHERE next IS NOT NULL),
seeds AS (
  SELECT DISTINCT b.d, x.i - b.i AS q FROM names b JOIN names x ON x.d = b.d AND x.size = b.size AND x.name = b.name AND x.i // x.size = b.i // b.size + 1
  WHERE b.i % b.size = 0),
odd AS (
  SELECT s.d, s.q, x.i, x.name = y.name AS same
  FROM seeds s JOIN words x ON x.d = s.d JOIN words y ON y.d = s.d AND y.i = x.i - s.q),
islands AS (
  SELECT d, q, min(i) - q AS start, max(i) + 1 AS stop
  FROM (SELECT *, row_number() OVER (PARTITION BY d, q ORDER BY i) - i AS island FROM odd WHERE same)
  GROUP BY d, q, island),
runs AS (
  SELECT d, start, stop - start AS length, min(q) AS period FROM islands WHERE stop - start >= greatest(6, 4 * q) GROUP BY d, start, stop),
told AS (
  SELECT d, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         min({'l': -length, 's': start, 'p': period}) AS longest
  FROM runs GROUP BY d),
gone AS (SELECT d, list_distinct(flatten(list(range(start + period, start + length)))) AS places FROM runs GROUP BY d),
kept AS (
  SELECT d, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT d, unnest(w) AS word, unnest(range(len(w))) AS i FROM damaged)
  WHERE (d, i) NOT IN (SELECT d, unnest(places) FROM gone)
  GROUP BY d)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, longest.s::BIGINT AS start, (-longest.l)::BIGINT AS length, longest.p::BIGINT AS period,
       (1000 * -longest.l // longest.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM damaged LEFT JOIN told USING (d) LEFT JOIN kept USING (d)
"""

QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLE_SQL = {"op12_periodic_runs": SQL}
