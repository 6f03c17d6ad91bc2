"""Tables as trees of files: one folder a key, written by the tasks and put in place by the commit.

``write_tree`` writes rows (dir, name, text) as ``folder/dir/name``. Tasks write into a folder aside, one for each
attempt; only when all are done does the driver move what the successful attempts wrote, a whole ``dir`` by one rename.
An attempt that was lost, or a job that failed, leaves nothing under the names that readers use. Writing the same rows
again replaces their files. Folders of ``dir`` are dealt to tasks, so each is written by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.columns import commit_folder

ASIDE = "_aside"


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    """The store of a path or an address, and the path within it."""
    return stores.FileSystem.from_uri(path) if ":/" in path else (stores.LocalFileSystem(), path)


def inside(name: str | None) -> str:
    """A relative name; one that leads out of its folder is refused."""
    parts = (name or "").split("/")
    if not name or name.startswith(("/", "\\")) or any(p in ("", ".", "..") for p in parts) or parts[0].startswith(ASIDE):
        raise ValueError(f"not a name within a folder: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class TreeWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.run = path.rstrip("/"), f"{ASIDE}-{uuid.uuid4().hex}"
        if not {"dir", "name", "text"} <= set(schema.names):
            raise ValueError("a tree of files needs the columns dir, name and text")

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = store_of(self.path)
        task = TaskContext.get()
        own = f"{root}/{self.run}/{task.partitionId()}-{task.taskAttemptId()}"
        made, files = set(), 0
        for row in iterator:
            at = f"{own}/{inside(row['dir'])}/{inside(row['name'])}"
            folder = at.rpartition("/")[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            text = row["text"]
            with store.open_output_stream(at) as out:
                out.write(bytes(text) if isinstance(text, (bytes, bytearray)) else (text or "").encode())
            files += 1
        return Written(own, files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.path)
        for message in messages:
            if message is not None and message.files:
                for entry in store.get_file_info(stores.FileSelector(message.folder)):
                    self._move(store, entry, f"{root}/{entry.base_name}")
        self.abort(messages)
        store.create_dir(root, recursive=True)
        store.open_output_stream(f"{root}/_SUCCESS").close()

    def _move(self, store: stores.FileSystem, entry: stores.FileInfo, to: str) -> None:
        there = store.get_file_info(to)
        if entry.type == stores.FileType.Directory and there.type == stores.FileType.Directory:
            for below in store.get_file_info(stores.FileSelector(entry.path)):
                self._move(store, below, f"{to}/{below.base_name}")
            return
        if there.type == stores.FileType.File:
            store.delete_file(to)
        store.move(entry.path, to)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.path)
        if store.get_file_info(f"{root}/{self.run}").type == stores.FileType.Directory:
            store.delete_dir(f"{root}/{self.run}")


class FileTree(DataSource):
    """``df.write.format("file_tree").mode("append").save(folder)`` of rows (dir, name, text)."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "dir string, name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise ValueError("a tree of files is added to; remove its folder to begin anew")
        return TreeWriter(self.options["path"], schema)


def write_tree(rows: DataFrame, folder: str) -> None:
    spark = rows.sparkSession
    spark.dataSource.register(FileTree)
    rows.select("dir", "name", "text").repartition("dir").write.format("file_tree").mode("append").save(folder)


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(dir, name, text) of the files one folder down; Spark's readers pass over empty files."""
    files = spark.read.format("binaryFile").load(f"{folder}/*/*")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("dir"), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("name"), F.decode("content", "UTF-8").alias("text"))


def meta_files(clean: DataFrame) -> DataFrame:
    """(dir, name, text): ``meta.json`` of each clean fix, as the table ``clean_fix_meta`` has it; ``read_meta`` reads it."""
    return clean.select(commit_folder(F.col("repository"), F.col("commit_hash")).alias("dir"), F.lit("meta.json").alias("name"), F.to_json(F.struct(*clean.columns)).alias("text"))
