"""Query of approximate nearest neighbours. Its recall is measured against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .learned import nearest_neighbours


def op8_learned_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES = {"op8_learned_ann": op8_learned_ann}
ORACLE_SQL: dict[str, str] = {}
