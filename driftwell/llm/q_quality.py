"""Query of the quality classifier. It is tested by held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality import fit, score_documents


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", "score", "text_score", "metadata_score", "keep")


QUERIES = {"op9_quality": op9_quality}
ORACLE_SQL: dict[str, str] = {}
