"""Named tables under a root and a tag. A tag is a directory of its own, and an argument, never a global.

A batch that writes several logs is committed by a manifest: each log's rows go to a folder of their own, and one small
file, put in place by a rename, names them all. Readers look at manifests alone, so they see all of a batch or nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .schemas import SCHEMAS

#: Logs in which a later row replaces an earlier one, and their keys.
NEWEST = {"outcomes": ["repository", "commit_hash"]}
#: The batch of what was taken over from another tag, before all others.
IMPORT = -1


class Catalog:
    """Tables as Parquet under ``root/tag/name``; a written table gets a new folder, and a pointer names the current."""

    def __init__(self, spark: SparkSession, root: str, tag: str = "default") -> None:
        self.spark, self.root, self.tag = spark, root, tag

    def path(self, name: str) -> str:
        return f"{self.root}/{self.tag}/{name}"

    def read(self, name: str) -> DataFrame:
        """The current version; an empty table of its schema if it was never written."""
        try:
            version = self.spark.read.schema("at long, version string").json(f"{self.path(name)}/_current").orderBy("at", "version", ascending=False).first()
        except Exception as e:  # Spark says that a path is missing in an analysis error
            if "PATH_NOT_FOUND" not in str(e):
                raise
            version = None
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.parquet(f"{self.path(name)}/{version['version']}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write a new version, then point to it: readers see the old or the new table, never a part of it."""
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.path(name)}/{version}")
        now = self.spark.sql("SELECT unix_micros(current_timestamp()) AS at").first()["at"]
        self.spark.createDataFrame([(now, version)], "at long, version string").coalesce(1).write.mode("append").json(f"{self.path(name)}/_current")

    def versions(self, name: str, keep: int = 5) -> int:
        """Leave the newest ``keep`` pointers of a table alone in its pointer folder; how many there are then."""
        pointers = self.spark.read.schema("at long, version string").json(f"{self.path(name)}/_current")
        newest = [tuple(r) for r in pointers.orderBy("at", "version", ascending=False).limit(keep).collect()]
        self.spark.createDataFrame(newest, "at long, version string").coalesce(1).write.mode("overwrite").json(f"{self.path(name)}/_current")
        return len(newest)

    def append(self, name: str, rows: DataFrame, batch: int | None = None) -> None:
        """Add rows to a log table; with a batch number the batch is written once, however often it's tried."""
        rows.write.mode("overwrite" if batch is not None else "append").parquet(f"{self.path(name)}/log" + (f"/batch={batch}" if batch is not None else f"/batch=-1/part={uuid.uuid4().hex}"))

    def _fs(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _manifest(self, file: str, lines: list[dict]) -> None:
        """A manifest is there whole or not at all: it is written aside, then renamed."""
        fs, aside = self._fs(f"{self.path('_batches')}/.{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray("".join(json.dumps(x) + "\n" for x in lines), "utf-8"))
        out.close()
        _, final = self._fs(f"{self.path('_batches')}/{file}")
        if fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, False)  # another try of the batch has come first

    def committed(self, batch: int) -> bool:
        if self._exists(f"{self.path('_batches')}/{batch}.json"):
            return True
        return any(x["upto"] and x["batch"] >= batch for x in self._named())

    def commit(self, batch: int, tables: dict[str, DataFrame]) -> None:
        """Write a batch's rows of several logs, then show them all at once. A committed batch isn't written again."""
        if self.committed(batch):
            return
        lines = []
        for name, rows in tables.items():
            folder = f"batches/{batch}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path(name)}/{folder}")
            lines.append({"batch": batch, "upto": False, "name": name, "folder": folder})
        self._manifest(f"{batch}.json", lines)

    def _named(self) -> list[dict]:
        """What manifests name: the newest compaction, and the batches after it. A few lines for each of these."""
        folder = self.path("_batches")
        if not self._exists(folder):
            return []
        rows = [r.asDict() for r in self.spark.read.schema("batch long, upto boolean, name string, folder string").json(folder).collect()]
        last = max((r["batch"] for r in rows if r["upto"]), default=IMPORT - 1)
        return [r for r in rows if r["batch"] > last or r["upto"] and r["batch"] == last]

    def compact(self) -> int:
        """One folder for each log instead of one for each batch; of outcomes the newest alone. Gives the last batch."""
        named = self._named()
        last, lines = max((r["batch"] for r in named), default=IMPORT - 1), []
        for name in sorted({r["name"] for r in named}):
            folder = f"batches/{last}-{uuid.uuid4().hex}"
            self.log(name).write.parquet(f"{self.path(name)}/{folder}")
            lines.append({"batch": last, "upto": True, "name": name, "folder": folder})
        if lines:
            self._manifest(f"upto-{last}.json", lines)
        return last

    def log(self, name: str, but: int | None = None) -> DataFrame:
        """The rows of a log, without those of the batch ``but``; of outcomes the newest of each commit. Empty if never written."""
        paths = [f"{self.path(name)}/{r['folder']}" for r in self._named() if r["name"] == name]
        paths += [f"{self.path(name)}/log"] if self._exists(f"{self.path(name)}/log") else []
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        rows = self.spark.read.schema(SCHEMAS[name]).option("recursiveFileLookup", "true").parquet(*paths)
        rows = rows.withColumn("_batch", F.regexp_extract("_metadata.file_path", r"/(?:log/batch=|batches/)(-?\d+)", 1).cast("int"))
        if but is not None:
            rows = rows.filter(F.col("_batch") != but)
        if name in NEWEST:
            newest = Window.partitionBy(*NEWEST[name]).orderBy(F.col("processed_at").desc(), F.col("_batch").desc())
            rows = rows.withColumn("_newest", F.row_number().over(newest)).filter("_newest = 1").drop("_newest")
        return rows.drop("_batch")
