"""Rows dealt to tasks by number, for steps whose rows cost much time and few bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to as many tasks as a shuffle has.

    Files and shuffles are cut by bytes, so that 60,000 short texts are one task; parsing them takes that task minutes.
    A number that is asked for isn't lessened afterwards.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Rows that a task sorts and groups at once, where a shuffle's size is given by its rows.
TASK_ROWS = 500_000


def dealt_by(key: str, largest: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """Tables to be joined and grouped by ``key``, in as many parts as keep a task's rows the same at every size.

    Shuffles have a fixed number of parts, and small compressed rows are put together again to fewer, so what a task
    sorts and groups grows with the tables. Where each core has no more than TASK_ROWS, Spark's own parts do.
    """
    n = -(-largest.count() // TASK_ROWS)
    if n <= largest.sparkSession.sparkContext.defaultParallelism:
        return [largest, *others]
    return [rows.repartition(n, key) for rows in (largest, *others)]
