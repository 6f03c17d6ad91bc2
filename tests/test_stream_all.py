"""The command stream-all: progress, a stop between batches, the pattern catalog of all that was done."""

from __future__ import annotations

import os
import signal
import sys
import threading
import time

from driftwell import cli
from driftwell.catalog import Catalog
from driftwell.schemas import SCHEMAS

HEADER = "repository,commit_hash,committed_date,file_path,file_hash,previous_file_hash,git_change_type,valid_yaml,valid_workflow,probably_workflow\n"
SCANNER = """import json, sys
text = sys.stdin.read()
print(json.dumps([{"ident": "perm", "route": "permissions"}] if "write-all" in text else []))
"""


def test_progress_stop_and_patterns(spark, tmp_path, capsys):
    cat = Catalog(spark, str(tmp_path / "root"))
    texts = {f"{side}{i}": f"permissions: {word}\njobs: {{a: {{n: {i}}}}}\n" for i in range(2) for side, word in (("o", "write-all"), ("n", "read-all"))}
    cat.replace("blobs", spark.createDataFrame([(k, bytearray(v, "utf8")) for k, v in texts.items()], SCHEMAS["blobs"]))
    cat.replace("repos", spark.createDataFrame([("o/r", "main")], SCHEMAS["repos"]))
    cat.replace("commit_on_branch", spark.createDataFrame([("o/r", "main", f"c{i}", True) for i in range(2)], SCHEMAS["commit_on_branch"]))
    cat.replace("branches", spark.createDataFrame([("o/r", "v1", "h")], SCHEMAS["branches"]))
    (tmp_path / "index").mkdir()
    (tmp_path / "scan.py").write_text(SCANNER)
    for i in range(2):
        (tmp_path / "index" / f"{i}.csv").write_text(HEADER + f"o/r,c{i},2024-01-01T00:00:00Z,f.yml,n{i},o{i},M,True,True,True\n")
    run = lambda *more: cli.main(["stream-all", "--root", str(tmp_path / "root"), "--index", str(tmp_path / "index"), "--scanner", f"{sys.executable} {tmp_path / 'scan.py'}", "--files", "1", *more], spark)

    def interrupt():
        end = time.monotonic() + 240
        while not cat._exists(cat.path("_batches")) and time.monotonic() < end:
            time.sleep(0.2)
        os.kill(os.getpid(), signal.SIGINT)

    former = signal.getsignal(signal.SIGINT)
    threading.Thread(target=interrupt, daemon=True).start()
    run("--refresh", "0")
    done = cat.log("outcomes").count()
    assert done == 1  # the batch at work ended, others weren't begun
    said = capsys.readouterr().out
    assert "batch 0: 1 rows" in said, said
    got = run()
    assert cat.log("outcomes").count() == 2 and {r.outcome for r in cat.log("outcomes").collect()} == {"audited"} and "| audited | 2 | 1.0 |" in got
    (pattern,) = cat.read("patterns").collect()
    assert pattern.fixes == ["perm"] and pattern.n_commits == 2
    assert signal.getsignal(signal.SIGINT) is former and len(cat._named()) == len({x["name"] for x in cat._named()})
