"""Query of language identification. It is tested by held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .langid import fit, held_out, predict


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parser = fit(docs.filter(~held_out(F.col("doc_id"))))
    asked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(asked, parser).drop("text")


QUERIES = {"op10_language_id": op10_language_id}
ORACLE_SQL: dict[str, str] = {}
