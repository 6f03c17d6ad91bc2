"""The commands of the analyses: predicates compared, gaps drilled into, rules against statuses."""

from __future__ import annotations

from driftwell import cli
from driftwell.catalog import Catalog
from driftwell.schemas import SCHEMAS


def test_analyses(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    put = lambda name, rows: cat.replace(name, spark.createDataFrame(rows, SCHEMAS[name]))
    found = lambda *idents: [(i, "", "", f"r{k}") for k, i in enumerate(idents)]
    put("sampled_commits", [("o/r", f"c{i}", "2024", [("f.yml", f"n{i}", f"o{i}")]) for i in range(4)])
    put("scans", [(f"{s}{i}", True, None, found(*x)) for i, (o, n) in enumerate([(("p", "q"), ()), (("p", "p"), ("p",)), ((), ("q",)), (("p",), ("z", "z"))]) for s, x in (("o", o), ("n", n))])
    put("clean_fix_meta", [("o/r", "c0", None, 2, ["p", "q"], 1, []), ("o/r", "c1", None, 1, ["p"], 1, [])])
    put("gaps", [("o/r", "c0", "b1", "main", "ok", ["p", "q"], "gap", 0, ["q"]), ("o/r", "c0", "b2", "main", "ok", ["p", "q"], "already_fixed", 0, []), ("o/s", "c1", "b1", "main", "ok", ["p"], "gap", 0, ["p"])])
    put("history", [("o/r", "c0", "b2", "f.yml", "confirmed_backport", None, "s", None, 2, 9.0, "true_backport")])
    run = lambda name: cli.main([name, "--root", str(tmp_path)], spark)
    got = run("compare-filters")
    assert "| strict | loose_a | loose_b | loose_c |" in got and got.split("\n")[2].startswith("| 2 | 2 | 2 | 3 |"), got
    got = run("drill-gaps")
    assert "| 3 | 2 | 1 | 0 |" in got and "| o/r | 1 | 1 | 1 |" in got and "| b1 | 2 | 1 |" in got and "| q | 1 | 2 |" in got, got
    got = run("cross-rules")
    assert "| p | 2 | 1 |" in got and "| p | q | 1 | 1 |" in got and "| q | 1 | 0 | 0 |" in got and "| p | 1 | 1 | 0.5 |" in got, got
