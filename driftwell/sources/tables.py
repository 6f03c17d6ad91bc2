"""Readers and writers of the file formats: CSV index, JSON lines, blobs, meta files, WSP-like text and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.columns import commit_folder, flat_file_name
from ..schemas import SCHEMAS


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The commit index: CSV with a header, every column a string, so that 'True' stays text."""
    return spark.read.option("header", True).option("multiLine", False).schema(SCHEMAS["workflow_index"]).csv(path)


def read_jsonl(spark: SparkSession, path: str, name: str, strict: bool = False) -> DataFrame:
    """JSON lines of a named table. Lines that can't be read fail the job, or are left out."""
    reader = spark.read.schema(SCHEMAS[name] + ", _corrupt_record string").option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    rows = spark.read.schema(SCHEMAS[name]).option("mode", "FAILFAST").json(path) if strict else reader.json(path)
    return rows if strict else rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(fixes, template_hash) of a pattern catalog in JSON lines, the set as a key; a broken line fails the job."""
    from ..operators.chain import catalog_keys

    return catalog_keys(read_jsonl(spark, path, "patterns", strict=True))


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def last_of_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (a sequence or the rank of a source, ascending)."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def merge_scans(*sources: DataFrame) -> DataFrame:
    """Scans of several sources; a later source wins, a good scan over a failed one of the same source."""
    ranked = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for s in ranked[1:]:
        out = out.unionByName(s)
    return last_of_key(out.withColumn("_ok", F.col("ok").cast("int")), ["file_hash"], ["_source", "_ok"]).drop("_source", "_ok")


def done_keys(log: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a log has; rows without a whole key don't count."""
    return log.dropna(subset=keys).select(*keys).distinct()


def read_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """(file_hash, content) of files named by their hash."""
    return spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_hash"), "content")


def blob_texts(blobs: DataFrame) -> DataFrame:
    """UTF-8 with replacement characters for what isn't."""
    return blobs.select("file_hash", F.decode("content", "UTF-8").alias("text"))


def read_meta(spark: SparkSession, pattern: str) -> DataFrame:
    """Meta files of commit folders, with the folder's name as ``dir``."""
    rows = spark.read.schema(SCHEMAS["clean_fix_meta"]).option("multiLine", True).json(pattern)
    return rows.withColumn("dir", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def commit_export(clean: DataFrame, texts: DataFrame) -> DataFrame:
    """(dir, name, text) of the human-readable export: both versions of each file of a clean fix.

    Files of one name in a commit get ``.1``, ``.2`` and so on; versions without text get a placeholder.
    """
    files = clean.select("repository", "commit_hash", F.posexplode("files").alias("_at", "f")).withColumn("dir", commit_folder(F.col("repository"), F.col("commit_hash")))
    flat = files.withColumn("_name", flat_file_name(F.col("f.file_path")))
    twin = F.row_number().over(Window.partitionBy("dir", "_name").orderBy("_at")) - 1
    named = flat.withColumn("_name", F.concat("_name", F.when(twin > 0, F.concat(F.lit("."), twin.cast("string"))).otherwise("")))
    sides = named.select("dir", "_name", F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("f.previous_file_hash").alias("h")), F.struct(F.lit("after").alias("side"), F.col("f.file_hash").alias("h")))).alias("s"))
    found = sides.select("dir", "_name", "s.side", F.col("s.h").alias("file_hash")).join(texts, "file_hash", "left")
    return found.select("dir", F.concat("side", F.lit("__"), "_name", F.lit(".yml")).alias("name"), F.coalesce("text", F.lit("# missing blob\n")).alias("text"))
