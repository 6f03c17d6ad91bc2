"""Documents dealt evenly over tasks, and texts parsed once for each that is read."""

from __future__ import annotations

import yaml
from pyspark.sql import functions as F

from driftwell.functions import dealing, syntax
from driftwell.functions.trees import document_nodes, rewrite

TEXT = 'base: &b {x: 1}\nkeep: *b\n"a.b":\n  since: 2024-01-31   # last seen\n  gone: 1\n'


def test_documents_of_one_small_file_are_parsed_by_many_tasks(spark):
    docs = spark.range(64).coalesce(1).select(F.col("id").cast("string").alias("program"), F.concat(F.lit("a: "), "id").alias("text"))
    tasks = document_nodes(docs, ["program"]).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_an_operation_parses_the_text_that_it_made_and_no_other(monkeypatch):
    parsed, parse = [], yaml.parse
    monkeypatch.setattr(yaml, "parse", lambda text, **k: parsed.append(text) or parse(text, **k))
    done = rewrite(TEXT, [(["a.b"], "set", "since", '"2025-02-28"', None), (["a.b"], "remove", "gone", None, None)])
    assert done == TEXT.replace("2024-01-31", "'2025-02-28'").replace("  gone: 1\n", "")
    assert len(parsed) == 3


def test_values_are_those_of_the_loader():
    for text in (TEXT, "", "a: 1\n---\nb: 0o17\n", "on: yes\nx: [22:22, 1_000]\n"):
        assert syntax.load(text) == (list(yaml.load_all(text, Loader=syntax.Core)) or [None])


def test_parts_of_a_join_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(dealing, "TASK_ROWS", 10)
    lines, orders = spark.range(200).selectExpr("id % 50 AS k", "id"), spark.range(50).selectExpr("id AS k", "id AS v")
    few = dealing.dealt_by("k", lines.limit(30), orders)
    assert few[1] is orders
    a, b = dealing.dealt_by("k", lines, orders)
    assert a.rdd.getNumPartitions() == b.rdd.getNumPartitions() == 20
    assert a.join(b, "k").count() == 200
