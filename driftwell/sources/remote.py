"""A forge's REST interface as a Spark data source. Off unless a base address is given.

Keys to be asked for lie in a table: ``lookup`` writes them sorted to the shared folder, and each of its files is a
partition, read by the task that asks for its keys, so neither the driver nor an option ever holds them. A filter on
``repository`` is pushed down: files and keys of other repositories aren't asked for. A limit of requests a second is
dealt out to the partitions, so that all tasks together stay below it, however many run at a time.

Tables read from it have the schemas of the offline tables (repos, branches), so plans don't tell them apart. A
cache table with negative entries stands before it: only what neither it nor an earlier answer has is asked for.
"""

from __future__ import annotations

import base64
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyarrow import fs as stores, parquet
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators.lineage import settle, shared_folder
from ..schemas import SCHEMAS
from .filetree import store_of

CONNECT_AND_READ = 30
TRIES = 4
LONGEST_WAIT = 120
HISTORY_PAGES = 5


def next_link(header: str | None) -> str | None:
    """The address of the next page in a Link header."""
    found = re.search(r'<([^>]+)>;\s*rel="next"', header or "")
    return found[1] if found else None


def get_json(url: str, token: str | Callable[[], str] = "", opener=urllib.request.urlopen, sleep=time.sleep) -> tuple[object, str | None]:
    """(answer, next page); None for 404 and 422. Rate limits and server errors are waited for and tried again.

    A token may be a function, which is asked anew at each try, so that a renewed one is taken after a 401.
    """
    for attempt in range(TRIES):
        own = token() if callable(token) else token
        request = urllib.request.Request(url, headers={"Accept": "application/json"} | ({"Authorization": f"Bearer {own}"} if own else {}))
        try:
            with opener(request, timeout=CONNECT_AND_READ) as answer:
                return json.load(answer), next_link(answer.headers.get("Link"))
        except urllib.error.HTTPError as e:
            if e.code in (404, 422):
                return None, None
            if attempt + 1 == TRIES or e.code not in (401, 403, 429, 500, 502, 503, 504):
                raise
            reset = e.headers.get("X-RateLimit-Reset") if e.headers else None
            wait = float(reset) - time.time() if reset and e.code in (403, 429) else 2.0**attempt
            sleep(min(max(wait, 0.5), LONGEST_WAIT))
    raise AssertionError("tries end in a return or an error")


#: What each table is asked for by, beside the repository.
KEYS = {"repos": [], "branches": [], "commit_on_branch": ["branch", "commit_hash"], "commit_info": ["commit_sha"], "file_at_ref": ["ref", "path"], "file_history": ["branch", "path"]}


class Throttle:
    """Lets so many calls a second pass; without a rate all of them."""

    def __init__(self, rate: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.pause, self.clock, self.sleep, self.free = 1 / rate if rate else 0.0, clock, sleep, 0.0

    def __call__(self) -> None:
        if self.pause:
            now = self.clock()
            self.free = max(self.free, now) + self.pause
            self.sleep(max(0.0, self.free - self.pause - now))


class ForgeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.base, self.table = options["base"].rstrip("/"), options["table"]
        self.keys = options.get("keys")
        self.rate = float(options["rate"]) if options.get("rate") else None
        self.only: set[str] | None = None
        self.throttle: Callable[[], None] = lambda: None
        self.repositories = json.loads(options.get("repositories", "[]"))
        named = options.get("token_file")  # read at each request, so that a renewed token is taken
        self.token: str | Callable[[], str] = options.get("token", "") if not named else lambda: Path(named).read_text().strip()
        self.asked = json.loads(options.get("asked", "{}"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Repositories that are asked for by name; other filters stay Spark's."""
        for f in filters:
            named = {f.value} if isinstance(f, EqualTo) and f.attribute == ("repository",) else set(f.value) if isinstance(f, In) and f.attribute == ("repository",) else None
            if named is None:
                yield f
            else:
                self.only = named if self.only is None else self.only & named

    def wanted(self, repository: str | None) -> bool:
        return repository is not None and (self.only is None or repository in self.only)

    def partitions(self) -> list[InputPartition]:
        if not self.keys:
            return [InputPartition(r) for r in self.repositories if self.wanted(r)]
        store, root = store_of(self.keys)
        files = sorted(f.path for f in store.get_file_info(stores.FileSelector(root)) if f.path.endswith(".parquet"))
        if self.only is not None:  # keys are sorted, so a file's own bounds tell whether it has one of them
            files = [f for f in files if any(low <= r <= high for low, high in self.bounds(store, f) for r in self.only)]
        return [InputPartition((f, len(files))) for f in files]

    @staticmethod
    def bounds(store: stores.FileSystem, file: str) -> list[tuple[str, str]]:
        with store.open_input_file(file) as held:
            meta = parquet.ParquetFile(held).metadata
            at = meta.schema.names.index("repository")
            told = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        return [(t.min, t.max) if t is not None and t.has_min_max else ("", chr(0x10FFFF)) for t in told]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.keys:
            file, parts = partition.value
            self.throttle = Throttle(self.rate and self.rate / parts)
            store, _ = store_of(self.keys)
            with store.open_input_file(file) as held:
                for batch in parquet.ParquetFile(held).iter_batches(1000, columns=["repository", *KEYS[self.table]]):
                    for repository, *key in zip(*(c.to_pylist() for c in batch.columns)):
                        if self.wanted(repository) and None not in key:
                            yield from self.answers(repository, key)
            return
        yield from self.answers(partition.value, None)

    def answers(self, repository: str, key: list[str] | None) -> Iterator[tuple]:
        api = f"{self.base}/repos/{repository}"
        if key:
            yield from self.one(api, repository, *key)
            return
        # The other tables are asked for by key: "ref path" for files, "branch path" for histories, and so on.
        for asked in self.asked.get(repository, []):
            yield from self.one(api, repository, *asked)
        if self.table == "repos":
            answer, _ = self.ask(f"{self.base}/repos/{repository}")
            if isinstance(answer, dict):
                yield repository, answer.get("default_branch")
        elif self.table == "branches":
            url: str | None = f"{self.base}/repos/{repository}/branches?per_page=100"
            while url:
                answer, url = self.ask(url)
                for b in answer if isinstance(answer, list) else []:
                    yield repository, b["name"], (b.get("commit") or {}).get("sha")

    def ask(self, url: str) -> tuple[object, str | None]:
        self.throttle()
        return get_json(url, self.token)

    def one(self, api: str, repository: str, *key: str) -> Iterator[tuple]:
        quoted = [urllib.parse.quote(k, safe="/") for k in key]
        if self.table == "commit_on_branch":
            branch, sha = key
            answer, _ = self.ask(f"{api}/compare/{quoted[0]}...{quoted[1]}")
            yield repository, branch, sha, isinstance(answer, dict) and answer.get("status") in ("behind", "identical")
        elif self.table == "commit_info":
            answer, _ = self.ask(f"{api}/commits/{quoted[0]}")
            if isinstance(answer, dict):
                yield repository, key[0], answer["commit"]["committer"]["date"], next((p["sha"] for p in answer.get("parents", [])), None)
        elif self.table == "file_at_ref":
            ref, path = key
            answer, _ = self.ask(f"{api}/contents/{quoted[1]}?ref={quoted[0]}")
            there = isinstance(answer, dict) and "content" in answer  # a list is a folder
            yield repository, ref, path, base64.b64decode(answer["content"]) if there else None, answer.get("sha") if there else None, not there
        elif self.table == "file_history":
            branch, path = key
            url, seq = f"{api}/commits?sha={quoted[0]}&path={quoted[1]}&per_page=100", 0
            for _ in range(HISTORY_PAGES):
                answer, url = self.ask(url)
                for c in answer if isinstance(answer, list) else []:
                    yield repository, branch, path, seq, c["sha"], c["commit"]["committer"]["date"]
                    seq += 1
                if not url:
                    break


class ForgeSource(DataSource):
    """spark.read.format("forge") with the options base, table, and keys: a folder of Parquet files (see ``lookup``).

    Or, for a few, repositories (JSON list) and asked (JSON: keys by repository).
    """

    @classmethod
    def name(cls) -> str:
        return "forge"

    def schema(self) -> str:
        return SCHEMAS[self.options["table"]]

    def reader(self, schema) -> ForgeReader:
        if not self.options.get("base"):
            raise ValueError("no base address is given; the forge is off")
        return ForgeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ForgeSource)


def lookup(wanted: DataFrame, table: str, base: str, rate: float | None = None, files: int = 64, **options: str) -> DataFrame:
    """The forge's rows of a table for keys (repository, and what KEYS names), each asked for once."""
    spark = wanted.sparkSession
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    columns, folder = ["repository", *KEYS[table]], f"{shared_folder(spark)}/keys-{uuid.uuid4().hex}"
    keys = wanted.select(*columns).distinct()
    keys.repartitionByRange(files, *columns).sortWithinPartitions(*columns).write.parquet(folder)
    given = {"base": base, "table": table, "keys": folder, **({"rate": str(rate)} if rate else {}), **options}
    return spark.read.format("forge").options(**given).load()


def read_through(wanted: DataFrame, cache: DataFrame, keys: list[str], fetch: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, new entries): cached answers, and those that ``fetch`` gives for the keys that the cache lacks.

    Keys that get none become negative entries (``missing``). The new entries are handed to ``keep``, such as
    ``lambda new: catalog.append(name, new)``, so that nobody asks for them again; without it that is the caller's.
    """
    known, todo = with_cache(wanted, cache, keys)
    todo = settle(todo)
    got = todo.join(fetch(todo).withColumn("missing", F.lit(False)), keys, "left")
    new = settle(got.withColumn("missing", F.coalesce("missing", F.lit(True))).select(cache.columns))
    if keep is not None:
        keep(new)
    return known.select(cache.columns).unionByName(new), new


def with_cache(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(known answers, keys still to be fetched). Cached rows with ``missing`` are answers too: that there is none."""
    keyed = wanted.select(*keys).distinct()
    return keyed.join(cache, keys), keyed.join(cache.select(*keys).distinct(), keys, "left_anti")


def decode_content(rows: DataFrame, encoded: str = "content_base64") -> DataFrame:
    return rows.withColumn("content", F.unbase64(F.regexp_replace(encoded, r"\s", ""))).drop(encoded)
