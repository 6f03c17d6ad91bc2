"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import sys
import tempfile
import types
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster shares."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, for checkpoints and tables written between two passes.

    It is ``spark.checkpoint.dir``; where that is unset, a folder of the warehouse. Only a session that is itself on
    one machine (tests) falls back to a temporary folder of it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] == "local":
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        return spark.sparkContext.getCheckpointDir()
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared one, in whatever store it is, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def carried(docs: DataFrame, needed: list[str]) -> DataFrame:
    """The rows as one column ``_row``, beside those of the needed columns that there are: no other name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c for c in needed if c in docs.columns])


def restored(rows: DataFrame, docs: DataFrame, **replaced: Column) -> DataFrame:
    """The columns of ``docs`` again, some replaced."""
    return rows.select(*[replaced.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def digest_int(text: Column) -> Column:
    """The first 52 bits of the MD5 of a string, as a non-negative long.

    MD5 rather than a Spark-only hash, so that any SQL engine can repeat every draw.
    """
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


#: Rows of a few longs that a broadcast may have; beyond, sides are joined by a shuffle.
BROADCAST_ROWS = 100_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of a few numbers a row, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept for the life of a Python worker and so shared by its tasks.

    Task functions travel by value, and with them their modules' globals; a module made here stays.
    """
    held = sys.modules.setdefault("driftwell_worker_cache", types.ModuleType("driftwell_worker_cache"))
    if name not in held.__dict__:
        setattr(held, name, make())
    return held.__dict__[name]


#: Rows of an Arrow batch that holds whole texts, so that a batch of long ones stays small in JVM and worker.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches have TEXT_ROWS rows at most; operators that ship whole texts call it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)


def ship(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast a fitted model of bounded size; tasks call the result once to get it.

    Broadcasts alone pickle classes by name, which executors without this package couldn't read.
    """
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(data.value)
