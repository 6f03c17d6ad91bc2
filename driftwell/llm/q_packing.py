"""Query of packing. SQL has no tokenizer, so it is tested by round trip."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack_documents

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), VOCABULARY).drop("ids")


QUERIES = {"op6_packing": op6_packing}
ORACLE_SQL: dict[str, str] = {}
