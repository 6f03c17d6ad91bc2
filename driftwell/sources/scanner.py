"""External checkers (a security scanner, a linter) run over distinct blobs, each blob once.

A checker is a command that reads a text on standard input and writes JSON, or a function from text to findings.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..schemas import SCHEMAS

TIMEOUT = 30


def command(argv: list[str], timeout: int = TIMEOUT) -> Callable[[bytes], list[dict]]:
    """A checker that runs a program; a non-zero exit, a time-out or an answer that isn't JSON is an error."""

    def check(content: bytes) -> list[dict]:
        done = subprocess.run(argv, input=content, capture_output=True, timeout=timeout, check=False)
        if done.returncode:
            raise ValueError(done.stderr.decode("utf-8", "replace")[:200] or f"exit {done.returncode}")
        return json.loads(done.stdout or b"[]")

    return check


def judged(checker: Callable[[bytes], list[dict]], content: bytes | None) -> tuple[bool, str | None, list[dict] | None]:
    """(ok, error, findings) of one blob: an error is a value, not an exception."""
    try:
        if content is None:
            raise ValueError("no content")
        return True, None, [{k: str(f.get(k) or "") for k in ("ident", "severity", "confidence", "route")} for f in checker(bytes(content))]
    except Exception as e:  # whatever a checker raises befalls its blob alone
        return False, f"{e}"[:200] or type(e).__name__, None


def scan(blobs: DataFrame, checker: Callable[[bytes], list[dict]], done: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Scans (file_hash, ok, error, findings) of blobs (file_hash, content) that ``done`` doesn't have.

    Each hash is scanned once. Failed scans in ``done`` are tried again.
    """
    todo = blobs.dropDuplicates(["file_hash"])
    if done is not None:
        todo = todo.join(done.filter("ok").select("file_hash").distinct(), "file_hash", "left_anti")
    if partitions:
        todo = todo.repartition(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *judged(checker, content)) for key, content in zip(batch["file_hash"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["file_hash", "ok", "error", "findings"])

    return todo.select("file_hash", "content").mapInPandas(run, SCHEMAS["scans"])


def ident_sets(scans: DataFrame) -> DataFrame:
    """(file_hash, idents); null where the scan failed."""
    return scans.select("file_hash", F.when(F.col("ok"), F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["ident"])))).alias("idents"))
