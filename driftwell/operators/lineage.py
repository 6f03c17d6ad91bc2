"""Cutting lineage where a plan would read the same rows many times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``; where that is unset, the warehouse's.

    Only a session that is itself on one machine (tests) falls back to a temporary folder of it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] == "local":
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        return spark.sparkContext.getCheckpointDir()
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def settle(df: DataFrame) -> DataFrame:
    """Written once to the shared folder that spark.checkpoint.dir names, so later reads survive lost executors.

    Where the session has none, see shared_folder().
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def unsized(df: DataFrame) -> DataFrame:
    """df as rows of unknown size, where the files that they come of tell nothing of it (parsed or composed texts).

    Spark takes what comes of a small file to be small, checkpointed or not, and sends it through the driver to join it.
    Of an RDD, an empty one here, it knows no size: joins are shuffled, and broadcast where what was shuffled proves small.
    """
    empty = df.sparkSession.createDataFrame(df.sparkSession.sparkContext.emptyRDD(), df.schema)
    return df.unionAll(empty)
