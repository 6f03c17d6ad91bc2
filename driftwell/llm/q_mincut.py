"""Query of the extraction of main texts. It is tested against written-out texts, and its cuts by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .mincut import fit, main_text


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fit(pages)).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op11_html_extraction": op11_html_extraction}
ORACLE_SQL: dict[str, str] = {}
