"""Query of SimHash near-dedup. SQL engines lack the seeded hash, so it is tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .simhash import near_duplicates


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), radius=3, shingle=3).drop("component")


QUERIES = {"op2_simhash_dedup": op2_simhash_dedup}
ORACLE_SQL: dict[str, str] = {}
