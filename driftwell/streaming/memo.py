"""What was scanned, as keyed state: a blob is scanned once over all batches, whichever branch or commit asks for it.

The state of a streaming query is keyed by blob hash and kept in RocksDB, with its checkpoint in the shared folder. A
question is a few files of blobs; the query reads them, looks each hash up where its state is, runs the checker over
those that aren't known, and answers all. So a question costs what its own blobs cost, not what the log holds. Failed
scans aren't kept, and are tried again when they are asked for again; known ones are scanned anew once ``ttl`` seconds
have passed. A question that was cut off is answered by the next start from the checkpoint.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import FINDING, SCHEMAS
from ..sources.scanner import judged

ASKED = "ask string, file_hash string, content binary"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Once(StatefulProcessor):
    """Answers from the state of a hash; the checker runs where there is none, or an old one."""

    def __init__(self, checker: Callable[[bytes], list[dict]], ttl: float | None) -> None:
        self.checker, self.ttl = checker, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("scan", f"at double, findings array<{FINDING}>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        answer = None
        if self.known.exists():
            at, findings = self.known.get()
            if self.ttl is None or time.time() - at < self.ttl:
                answer = (True, None, [f.asDict() if hasattr(f, "asDict") else dict(f) for f in findings])
        for batch in rows:
            out = []
            for ask, content in zip(batch["ask"], batch["content"]):
                if answer is None:
                    answer = judged(self.checker, content)
                    if answer[0]:
                        self.known.update((time.time(), [tuple(f.values()) for f in answer[2]]))
                out.append((ask, key[0], *answer))
            yield pd.DataFrame(out, columns=["ask", "file_hash", "ok", "error", "findings"])

    def close(self) -> None:
        pass


class ScanMemo:
    """Scans of blobs, each scanned once. ``folder`` lies where all machines reach it; ``parts`` is fixed with the first question."""

    def __init__(self, spark: SparkSession, folder: str, checker: Callable[[bytes], list[dict]], ttl: float | None = None, parts: int | None = None) -> None:
        self.spark, self.folder, self.checker, self.ttl = spark, folder, checker, ttl
        self.parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ask(self, blobs: DataFrame) -> DataFrame:
        """Scans (file_hash, ok, error, findings) of blobs (file_hash, content), one row a hash."""
        if blobs.isEmpty():  # nothing is asked, and before the first question there is nothing to read
            return self.spark.createDataFrame([], SCHEMAS["scans"])
        name = uuid.uuid4().hex
        blobs.dropDuplicates(["file_hash"]).select(F.lit(name).alias("ask"), "file_hash", "content").write.mode("append").parquet(f"{self.folder}/asked")
        settings = {STORE: ROCKS, "spark.sql.shuffle.partitions": str(self.parts)}
        former = {k: self.spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            stream = self.spark.readStream.schema(ASKED).parquet(f"{self.folder}/asked")
            answers = stream.groupBy("file_hash").transformWithStateInPandas(Once(self.checker, self.ttl), outputStructType=f"ask string, {SCHEMAS['scans']}", outputMode="Append", timeMode="None")
            sink = answers.writeStream.format("parquet").option("path", f"{self.folder}/answers").partitionBy("ask").option("checkpointLocation", f"{self.folder}/state")
            sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        finally:
            for k, v in former.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        found = self.spark.read.schema(f"{SCHEMAS['scans']}, ask string").parquet(f"{self.folder}/answers")
        return found.filter(F.col("ask") == name).drop("ask")
