"""The incremental driver: new rows of the commit index, batch by batch, each commit to one terminal outcome.

A checkpoint says which files were read; a batch's logs are shown together by one manifest under the batch's number, so
a batch that was cut off leaves nothing, and one that is done isn't done again. File-diffs that the index log has
already are left out by key, so replayed files add nothing. A commit that gets more file-diffs is judged anew over all
of them; of its outcomes the log gives the newest.
"""

from __future__ import annotations

import signal
import threading
import time
from collections.abc import Callable
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog import IMPORT, Catalog
from ..functions.columns import commit_folder
from ..operators import chain, diffs, evaluation, gaps, sampling
from ..operators.chain import COMMIT
from ..operators.lineage import settle
from ..schemas import SCHEMAS
from ..sources import tables

#: Outcomes of a commit.
OUTCOMES = ("audited", "host_removed", "not_clean_fix", "blob_missing", "audit_failed", "exception")


def commit_outcomes(index: DataFrame, scans: DataFrame, classification: DataFrame, audits: DataFrame) -> DataFrame:
    """One row a commit: its outcome and reason. The order is that of the chain: blobs, fix, host, audit.

    A clean fix without a kind, or a structural one that wasn't audited, is an ``audit_failed``, never ``audited``.
    """
    files = sampling.valid_modifications(index)
    met = diffs.file_findings(diffs.join_scans(files, scans))
    commits = diffs.commit_roll_up(met)
    commits = commits.join(classification.select("repository", "commit_hash", "kind"), ["repository", "commit_hash"], "left")
    commits = commits.join(audits.select("repository", "commit_hash", F.col("status").alias("_audit")).distinct(), ["repository", "commit_hash"], "left")
    missing = F.forall("files", lambda f: f["scan_status"] != "ok")
    outcome = (
        F.when(missing, "blob_missing").when((F.size("V_fixed") == 0) | (F.size("V_introduced") > 0), "not_clean_fix")
        .when(F.col("kind") != "structural", "host_removed").when(F.col("_audit") == "ok", "audited").otherwise("audit_failed")
    )
    reason = F.when(outcome == "not_clean_fix", F.when(F.size("V_fixed") == 0, "no_v_fixed").otherwise("v_introduced_nonempty")).when(outcome == "audit_failed", F.coalesce("_audit", F.lit("not_audited")))
    return commits.select("repository", "commit_hash", outcome.alias("outcome"), reason.alias("reason"))


#: Tries that a batch may take to find the commits that break it.
TRIES = 64


def good_rows(whole: DataFrame, work: Callable[[DataFrame], dict[str, DataFrame]], tries: int = TRIES) -> tuple[dict[str, DataFrame], list[tuple[DataFrame, str]]]:
    """(tables of the commits that work, (commits, error) of those that don't).

    Errors of single rows are values already (an unread document, a failed scan). Where a job fails for all that, the
    batch's commits are halved by their hash until those that break it stand alone; others keep their results. After
    ``tries`` runs what is still open counts as failed.
    """
    done: dict[str, DataFrame] = {}
    failed: list[tuple[DataFrame, str]] = []
    # a part is what a number of bits of the commits' hash are
    todo, h = [(0, 0)], F.xxhash64(*COMMIT)
    while todo:
        bits, value = todo.pop()
        part = settle(whole.filter(F.pmod(h, F.lit(1 << bits)) == value)) if bits else whole
        n = part.select(*COMMIT).distinct().limit(2).count()
        if not n:
            continue
        tries -= 1
        try:
            for name, rows in work(part).items():
                done[name] = done[name].unionByName(rows) if name in done else rows
        except Exception as e:  # whatever the job died of
            if n == 1 or bits == 60 or tries <= 0:
                failed.append((part.select(*COMMIT).distinct(), f"{type(e).__name__}: {e}"[:200]))
            else:
                todo += [(bits + 1, value + (1 << bits)), (bits + 1, value)]
    return done, failed


def process_batch(catalog: Catalog, scans: Callable[[DataFrame], DataFrame], texts: Callable[[DataFrame], DataFrame], source: str = "stream", log_errors: bool = True, step: int = 8) -> Callable[[DataFrame, int], None]:
    """The function for foreachBatch: the whole chain for the commits with new file-diffs, to the log ``outcomes``.

    ``scans`` and ``texts`` give the scans (as the table ``scans``) and texts (file_hash, text) of distinct blobs; with
    ``ScanMemo`` behind ``scans`` no blob is scanned twice. The forge's tables (repos, branches, commit_on_branch,
    file_at_ref, file_history, commit_info) are the catalog's; of file_at_ref a batch reads its own commits' files at
    heads, and the versions that its histories walk through, in rounds. All of a batch's logs (scans, diffs,
    clean_fix_meta, classification, export, gaps, history, workflow_index, outcomes) are shown at once by a manifest.
    Commits that break the chain are logged as ``exception`` with the error, if ``log_errors``, and are taken up again
    with the next batch; others of their batch keep their outcomes.
    """

    def chain_of(whole: DataFrame) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        files = settle(sampling.valid_modifications(whole).drop("committed_date"))
        blobs = settle(sampling.distinct_blobs(files))
        scanned = out["scans"] = settle(scans(blobs))
        held = settle(texts(blobs))
        nodes = chain.parsed(held)
        out["diffs"] = settle(chain.usable_diffs(chain.diff_rows(files, nodes)))

        clean = settle(chain.clean_commits(files, scanned))
        fixed = settle(chain.fix_files(clean))
        need = sampling.distinct_blobs(fixed.filter(F.size("V_fixed") > 0)).join(held.filter("text is not null").select("file_hash"), "file_hash", "left_anti")
        lost = F.col("file_hash") == F.col("_h")
        missing = settle(fixed.filter(F.size("V_fixed") > 0).join(need.withColumnRenamed("file_hash", "_h"), lost | (F.col("previous_file_hash") == F.col("_h"))).select(*COMMIT).distinct())
        whole_fixes = settle(clean.join(missing, COMMIT, "left_anti"))
        by_file, kinds = chain.classify_hosts(settle(fixed.join(missing, COMMIT, "left_anti")), nodes)
        kinds = settle(kinds)
        out["clean_fix_meta"] = settle(meta_rows(whole_fixes))
        out["classification"] = settle(kinds.select(*COMMIT, "kind", commit_folder(F.col("repository"), F.col("commit_hash")).alias("dir")))
        out["export"] = settle(tables.commit_export(whole_fixes, held))

        read, structural = catalog.read, settle(whole_fixes.join(kinds.filter("kind = 'structural'").select(*COMMIT), COMMIT, "left_semi"))
        # of the forge's files those of the batch, at the heads of branches; contents stay where they are
        own = settle(chain.fix_files(structural).select("repository", F.col("file_path").alias("path")).distinct())
        refs = read("branches").select("repository", F.col("branch").alias("ref")).join(own.select("repository").distinct(), "repository", "left_semi").distinct()
        at_heads = settle(read("file_at_ref").join(own, ["repository", "path"], "left_semi").join(refs, ["repository", "ref"], "left_semi"))
        heads = at_heads.filter("content is not null").select(F.col("blob_sha").alias("file_hash")).distinct().join(scanned.select("file_hash"), "file_hash", "left_anti")
        known = settle(scanned.unionByName(scans(settle(heads)))) if at_heads.limit(1).count() else scanned
        audits = settle(gaps.audit(structural, read("repos"), read("branches"), read("commit_on_branch"), at_heads, known))
        out["gaps"] = audits.select(*COMMIT, "branch", "default_branch", "status", "V_fixed_idents", "verdict", "n_scan_failed", "idents_present")
        fetch = lambda asked: read("file_at_ref").withColumnRenamed("ref", "commit_sha").join(asked, ["repository", "commit_sha", "path"], "left_semi")
        walked, _ = chain.rounds_of_histories(audits, structural, read("file_history"), read("commit_info"), fetch, lambda b: scans(b.select("file_hash")), step)
        out["history"] = settle(walked.select(*[c.split()[0] for c in SCHEMAS["history"].split(", ")]))
        found = commit_outcomes(whole, scanned, kinds, audits)
        lost_ones = missing.withColumn("_lost", F.lit(True))
        met = found.join(lost_ones, COMMIT, "left")
        out["outcomes"] = settle(met.withColumns({"outcome": F.when(F.col("_lost"), "blob_missing").otherwise(F.col("outcome")), "reason": F.when(F.col("_lost").isNull(), F.col("reason"))}).drop("_lost"))
        return out

    def batch(rows: DataFrame, number: int) -> None:
        if catalog.committed(number):
            return
        seen = catalog.log("workflow_index")
        given = settle(rows.distinct())
        fresh = settle(gaps.not_done(given, seen.join(given.select(*COMMIT).distinct(), COMMIT, "left_semi"), ["repository", "commit_hash", "file_path"]))
        failed = catalog.log("outcomes").filter("outcome = 'exception'").select(*COMMIT)
        touched = settle(fresh.select(*COMMIT).unionAll(failed).distinct())
        # only what the log has of the batch's commits is written out, not the log
        whole = settle(seen.join(touched, COMMIT, "left_semi").unionByName(fresh))
        stamp, none = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit(None).cast("string")
        done, broken = good_rows(whole, chain_of) if log_errors else (chain_of(whole), [])
        found = [done.pop("outcomes").withColumn("error", none)] if "outcomes" in done else []
        for commits, error in broken:
            real = commits.join(sampling.valid_modifications(whole).select(*COMMIT).distinct(), COMMIT, "left_semi")
            found.append(real.withColumns({"outcome": F.lit("exception"), "reason": none, "error": F.lit(error)}))
        told = [r.select(*COMMIT, stamp.alias("processed_at"), F.lit(f"{source}-{number}").alias("source"), "outcome", "reason", "error") for r in found]
        outcomes = {"outcomes": reduce(DataFrame.unionByName, told)} if told else {}
        catalog.commit(number, {**done, "workflow_index": fresh, **outcomes})

    return batch


#: Tables of a tag that are taken over with its outcomes.
OWN = ("clean_fix_meta", "classification", "gaps", "history", "diffs", "export")


def take_over(catalog: Catalog, other: Catalog) -> bool:
    """Begin with what another tag has done: its audited commits with outcomes, fixes, kinds, audits, histories and files.

    Commits that this tag has outcomes for are left out. All tables come with one manifest, once; False if they had.
    Runs that follow don't judge these commits again unless their index gives them new file-diffs.
    """
    if catalog.committed(IMPORT):
        return False
    theirs = {n: settle(other.read(n).unionByName(other.log(n))) for n in OWN}
    own = settle(catalog.log("outcomes").select(*COMMIT))
    audits = theirs["gaps"].select(*COMMIT, "status").distinct().join(own, COMMIT, "left_anti")
    found = settle(evaluation.import_tag(audits, theirs["classification"], f"imported_from_{other.tag}"))
    outcomes = found.select(*[c.split()[0] for c in SCHEMAS["outcomes"].split(", ")])
    taken = outcomes.select(*COMMIT, commit_folder(F.col("repository"), F.col("commit_hash")).alias("dir"))
    rows = {n: theirs[n].join(taken.select(*(["dir"] if n == "export" else COMMIT)), ["dir"] if n == "export" else COMMIT, "left_semi").select(*theirs[n].columns) for n in OWN}
    catalog.commit(IMPORT, {**rows, "outcomes": outcomes})
    return True


def meta_rows(clean: DataFrame) -> DataFrame:
    """Clean fixes as rows of the table ``clean_fix_meta``."""
    named = F.transform("files", lambda f: F.struct(f["file_path"].alias("file_path"), f["previous_file_hash"].alias("before"), f["file_hash"].alias("after"), f["scan_status"].alias("scan_status"), f["V_fixed"].alias("V_fixed"), f["V_introduced"].alias("V_introduced")))
    return clean.select(*COMMIT, F.lit(None).cast("string").alias("github_url"), F.col("V_fixed_count").cast("int").alias("V_fixed_count"), "V_fixed_idents", F.col("n_files_modified").cast("int").alias("n_files_modified"), named.alias("files"))


def watch(query: StreamingQuery, say: Callable[[str], None] = print, total: int | None = None, every: float = 1.0) -> Callable[[], None]:
    """Say after each batch of a query how many rows it has read, how fast, and how long ``total`` rows will take.

    The query's own reports are looked at, in a thread. Gives a function that says what is left to say, and ends it.
    """
    ended, told = threading.Event(), []

    def look() -> None:
        new = [p for p in query.recentProgress if p["batchId"] not in told and p["numInputRows"]]
        for p in new:
            told.append(p["batchId"])
            rows, rate, left = progress_of(query, total)
            say(f"batch {p['batchId']}: {rows} rows, {rate:.1f} a second" + ("" if left is None else f", {left:.0f} s left"))

    def run() -> None:
        while not ended.wait(every):
            look()

    thread = threading.Thread(target=run, daemon=True)
    thread.start()

    def end() -> None:
        ended.set()
        thread.join()
        look()

    return end


class Stopped(RuntimeError):
    """A batch that wasn't begun because the run is to stop; the next start begins with it."""


def ask_to_stop(asked: threading.Event, number: int = signal.SIGINT) -> Callable[[], None]:
    """The first signal asks a run to stop after the batch at work, a second one ends the program at once.

    Gives a function that puts the former handler back. Signals reach a program's main thread alone.
    """
    former = signal.getsignal(number)

    def handler(got: int, frame: object) -> None:
        if asked.is_set():
            signal.signal(number, former)
            raise KeyboardInterrupt
        asked.set()

    signal.signal(number, handler)
    return lambda: signal.signal(number, former)


def run_available(
    spark: SparkSession, index_folder: str, catalog: Catalog, scans: Callable[[DataFrame], DataFrame], texts: Callable[[DataFrame], DataFrame],
    checkpoint: str, files_per_batch: int = 1000, log_errors: bool = True, started: Callable[[StreamingQuery], Callable[[], None]] | None = None, stop: threading.Event | None = None,
) -> StreamingQuery:
    """Process all index files that are there, then stop; what a stopped run had done isn't done again.

    ``started`` gets the query once it runs, such as ``watch``, and gives what is to be done when it has ended. Once
    ``stop`` is set, the batch at work ends, and no other begins.
    """
    batch = process_batch(catalog, scans, texts, log_errors=log_errors)

    def unless_stopped(rows: DataFrame, number: int) -> None:
        if stop is not None and stop.is_set():
            raise Stopped("no batch begins any more")
        batch(rows, number)

    stream = spark.readStream.schema(SCHEMAS["workflow_index"]).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(index_folder)
    query = stream.writeStream.foreachBatch(unless_stopped).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    ended = started(query) if started else None
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if stop is None or not stop.is_set() or "no batch begins any more" not in str(e):
            raise
    finally:
        if ended:
            ended()
    return query


def progress_of(query: StreamingQuery, total: int | None = None) -> tuple[int, float, float | None]:
    """(rows so far, rows a second, seconds left of ``total`` rows if it is known) by the query's own reports."""
    seen = [p for p in query.recentProgress if p["numInputRows"]]
    rows = sum(p["numInputRows"] for p in seen)
    rate = rows / max(sum(p["durationMs"]["triggerExecution"] for p in seen) / 1000, 1e-3) if seen else 0.0
    return rows, rate, (max(total - rows, 0) / rate if total is not None and rate else None)


def stop_on_signal(query: StreamingQuery, number: int = signal.SIGINT) -> Callable[[], None]:
    """The first signal lets the batch at work end and stops the query, a second one ends the program at once.

    Gives a function that puts the former handler back.
    """
    former = signal.getsignal(number)
    told: list[int] = []

    def handler(got: int, frame: object) -> None:
        told.append(got)
        if len(told) > 1:
            signal.signal(number, former)
            raise KeyboardInterrupt
        threading.Thread(target=drain, args=(query,), daemon=True).start()

    signal.signal(number, handler)
    return lambda: signal.signal(number, former)


def distinct_days(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """An extension over event streams: each user's different event types by day, late rows up to ``delay``."""
    timed = events.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", delay)
    return timed.groupBy(F.window("_at", "1 day").alias("_w"), "user_id", "event_type").agg(F.count("*").alias("n")).select(F.col("_w.start").alias("day"), "user_id", "event_type", "n")


def refresh_every(spark: SparkSession, job: Callable[[], None], interval: str = "30 minutes") -> StreamingQuery:
    """Run a job again and again, such as replacing the pattern catalog; runs never overlap."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda _, number: job()).trigger(processingTime=interval).start()


def drain(query: StreamingQuery, wait: float = 0.2, longest: float = 600.0) -> bool:
    """Stop a query between two batches; False if a batch went on for longer than ``longest`` seconds and was cut off.

    A batch that is cut off is done again at the next start, from the checkpoint.
    """
    end = time.monotonic() + longest
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < end:
        time.sleep(wait)
    idle = not query.isActive or not query.status["isTriggerActive"]
    query.stop()
    return idle
