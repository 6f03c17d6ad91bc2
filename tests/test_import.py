"""What another tag has done is taken over whole."""

from __future__ import annotations

from driftwell import cli
from driftwell.catalog import Catalog
from driftwell.schemas import SCHEMAS


def test_all_tables_of_a_tag_come_along(spark, tmp_path):
    old, new = Catalog(spark, str(tmp_path), "50k"), Catalog(spark, str(tmp_path), "full")
    frame = lambda rows, name: spark.createDataFrame(rows, SCHEMAS[name])
    meta = lambda c: ("o/r", c, None, 1, ["perm"], 1, [])
    old.replace("clean_fix_meta", frame([meta(f"c{i}") for i in range(4)], "clean_fix_meta"))
    old.replace("classification", frame([("o/r", "c0", "structural", "d"), ("o/r", "c1", "mixed", "d"), ("o/r", "c2", "structural", "d")], "classification"))
    old.replace("gaps", frame([("o/r", f"c{i}", "b", "main", "ok" if i != 2 else "repo_error", ["perm"], "gap", 0, []) for i in range(4)], "gaps"))
    old.append("history", frame([("o/r", "c0", "b", "f", "never_had_it", None, None, None, 1, None, "never_had_it")], "history"), batch=0)
    old.replace("export", frame([("o__r__c0", "before__f.yml", "x"), ("o__r__c9", "before__f.yml", "x")], "export"))
    new.commit(0, {"outcomes": frame([("o/r", "c3", "2024", "stream-0", "not_clean_fix", None, None)], "outcomes")})
    got = cli.main(["import", "--root", str(tmp_path), "--tag", "full", "--new", "50k"], spark)
    assert {r.commit_hash: (r.outcome, r.reason, r.source) for r in new.log("outcomes").collect()} == {
        "c0": ("audited", None, "imported_from_50k"), "c1": ("host_removed", None, "imported_from_50k"), "c2": ("audit_failed", "repo_error", "imported_from_50k"), "c3": ("not_clean_fix", None, "stream-0"),
    }
    assert "| audited | 1 | 0.25 |" in got
    assert {n: new.log(n).count() for n in ("clean_fix_meta", "classification", "gaps", "history", "export")} == {"clean_fix_meta": 3, "classification": 3, "gaps": 3, "history": 1, "export": 1}
    cli.main(["import", "--root", str(tmp_path), "--tag", "full", "--new", "50k"], spark)
    assert new.log("outcomes").count() == 4 and new.compact() == 0 and new.log("gaps").count() == 3
