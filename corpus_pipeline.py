"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Defined results of odd rows: documents with null texts, or texts of white space alone, go in the quality stage, texts
without letters in the language stage. Null ids, languages, sources and lengths are values like any other. Of rows that
are alike, and of documents with equal texts, one stays: that with the smallest id, rows without an id last. Extra
columns of any name pass through all stages but the last, which has its own. Very long texts are read whole. An empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwell.llm import langid, quality
from driftwell.llm.common import carried, remove, restored, shared_folder, table
from driftwell.llm.mixing import mix_texts
from driftwell.llm.packing import pack_documents
from driftwell.llm.q_packing import VOCABULARY
from driftwell.llm.simhash import keep_first

#: Scores of language identification (texts in one language have 0.67 and more): below the first no language stands
#: out; from the second on a document's own language is taken to be wrong if it differs. Documents that mix in some of
#: another language lie between the two and are kept.
UNDECIDED, CERTAIN = 0.505, 0.65


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; without labels of both kinds all that have a text stay."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return restored(quality.score_documents(carried(docs, ["text", "lang", "source", "n_chars"]), model).filter("keep"), docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, and not surely in another one than they say."""
    parser = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    judged = langid.predict(carried(docs, ["text", "lang"]), parser)
    wrong = (F.col("score") >= CERTAIN) & (F.col("lang_pred") != F.coalesce("lang", "lang_pred"))
    return restored(judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= UNDECIDED) & ~wrong), docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    Texts without words are one group. Ties of ids are broken by the text's hash, then by all columns.
    """
    return keep_first(docs, similarity=0.8, shingle=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each source that its target asks for: rows whose words aren't taken go, others may come twice."""
    return mix_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack_documents(docs, VOCABULARY).drop("ids")


STAGES = [("quality classifier", good_quality), ("language ID", known_language), ("SimHash near-dedup", without_copies), ("mixing sources", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            remove(spark, f"{folder}/{n - 1}")
    return docs
