"""Work on records within a time budget that is measured inside of tasks.

A record's items (the files of its branches) run side by side in a few threads of its task, since they wait for a forge
most of the time. When the record's seconds are over, what is done is kept, and the rest is ``timed_out``: a slow branch
doesn't cost the answers of the others. An item's own failure is a value as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import refined_status
from ..sources.scanner import judged
from .history import AT_HEAD, CAP, CAPPED, CONFIRMED, INCONCLUSIVE, NEVER, UNREADABLE

#: The status of what a budget left undone, and of what failed.
TIMED_OUT, ERROR = "timed_out", "error"
FOUND = "status string, reason string, backport_version string, backported_at string, n_read long"
NAMES = [c.split()[0] for c in FOUND.split(", ")]


def no_speculation(spark: SparkSession) -> None:
    """A second run of a slow task would ask the forge for everything twice, and measure another budget."""
    if spark.sparkContext.getConf().get("spark.speculation", "false").lower() == "true":
        raise ValueError("records with a time budget need spark.speculation to be off")


def run_record(items: list[dict], work: Callable[[dict], dict], seconds: float, workers: int) -> list[dict]:
    """What ``work`` gives for each item, in order; items not done after ``seconds`` are ``timed_out``.

    Threads can't be ended from outside: one that is late is left to end with its own request, and its answer is dropped.
    """
    pool = ThreadPoolExecutor(workers)
    tasks = [pool.submit(work, item) for item in items]
    done, _ = wait(tasks, timeout=seconds)
    pool.shutdown(wait=False, cancel_futures=True)
    out = []
    for task in tasks:
        if task not in done:
            out.append({"status": TIMED_OUT, "reason": TIMED_OUT})
        elif task.exception() is not None:
            out.append({"status": ERROR, "reason": f"{type(task.exception()).__name__}: {task.exception()}"[:200]})
        else:
            out.append(task.result())
    return out


def walk_one(versions: Iterable[tuple[str, str]], content: Callable[[str], bytes | None], checker: Callable[[bytes], list[dict]], idents: set[str], cap: int = CAP) -> dict:
    """The back-port in one file's history, versions (name, time) newest first, each fetched when it is its turn."""
    newer, n = None, 0
    told = lambda status, reason=None, at=(None, None): {"status": status, "reason": reason, "backport_version": at[0], "backported_at": at[1], "n_read": n}
    for name, time in versions:
        if n >= cap:
            return told(INCONCLUSIVE, CAPPED)
        try:
            body = content(name)
        except (OSError, ValueError):
            continue
        ok, _, findings = judged(checker, body) if body is not None else (False, None, None)
        if not ok:
            continue
        n += 1
        if idents & {f["ident"] for f in findings}:
            return told(CONFIRMED, None, newer) if newer else told(INCONCLUSIVE, AT_HEAD)
        newer = (name, time)
    return told(NEVER) if n else told(INCONCLUSIVE, UNREADABLE)


def histories_within(
    asked: DataFrame, forge: Callable[[], object], checker: Callable[[bytes], list[dict]], seconds: float,
    record: tuple[str, ...] = ("repository", "commit_hash"), workers: int = 8, cap: int = CAP,
) -> DataFrame:
    """asked (record, branch, path, V_fixed_idents) with FOUND: each record's histories walked within ``seconds``.

    ``forge`` makes a client in the task, with ``versions(repository, branch, path)`` and ``content(repository, path,
    version)``. A record is the rows of one commit, a few for each of its branches.
    """
    no_speculation(asked.sparkSession)
    columns = [*record, "branch", "path", "V_fixed_idents"]
    schema = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in columns)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        client = forge()

        def one(item: dict) -> dict:
            repository, path = item["repository"], item["path"]
            return walk_one(client.versions(repository, item["branch"], path), lambda v: client.content(repository, path, v), checker, set(item["V_fixed_idents"]), cap)

        group = group.sort_values(["branch", "path"], kind="stable")
        found = run_record(group.to_dict("records"), one, seconds, workers)
        for c in NAMES:
            group[c] = pd.Series([f.get(c) for f in found], index=group.index, dtype="Int64" if c == "n_read" else object)
        return group

    return asked.select(*columns).groupBy(*record).applyInPandas(run, f"{schema}, {FOUND}")


def refined(found: DataFrame, lag: str = "lag_days") -> DataFrame:
    """With ``refined``; what a budget left undone, or what failed, stays what it is."""
    undone = F.col("status").isin(TIMED_OUT, ERROR)
    return found.withColumn("refined", F.when(undone, F.col("status")).otherwise(refined_status(F.col("status"), F.col(lag))))


def over_budget(found: DataFrame, record: tuple[str, ...] = ("repository", "commit_hash")) -> DataFrame:
    """(record, n_done, n_timed_out) of the records whose time was over."""
    late = F.count_if(F.col("status") == TIMED_OUT)
    return found.groupBy(*record).agg(F.count_if(F.col("status") != TIMED_OUT).alias("n_done"), late.alias("n_timed_out")).filter("n_timed_out > 0")
