"""Trees of files: written aside, moved by the commit, read back."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from driftwell.schemas import SCHEMAS
from driftwell.sources.filetree import inside, meta_files, read_tree, write_tree
from driftwell.sources.tables import read_meta

SCHEMA = "dir string, name string, text string"


def listed(folder):
    return sorted(os.path.relpath(os.path.join(at, f), folder) for at, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def test_round_trip_and_replacement(spark, tmp_path):
    rows = [(f"d{i % 3}", f"f{i}.yml", f"text é {i}\n") for i in range(12)] + [("d0", "a b+c.yml", "x"), ("d0", "none.yml", None)]
    write_tree(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "t"))
    assert listed(tmp_path / "t") == sorted(["_SUCCESS", *[f"{d}/{n}" for d, n, _ in rows]])
    assert {tuple(r) for r in read_tree(spark, str(tmp_path / "t")).collect()} == {(d, n, t) for d, n, t in rows if t}  # Spark's readers pass over empty files
    write_tree(spark.createDataFrame([("d0", "f0.yml", "new"), ("d9", "x", "y")], SCHEMA), f"file://{tmp_path}/t")
    got = {(r.dir, r.name): r.text for r in read_tree(spark, str(tmp_path / "t")).collect()}
    assert got["d0", "f0.yml"] == "new" and got["d9", "x"] == "y" and len(got) == len(rows)


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i}", "f", str(i)) for i in range(8)], SCHEMA)
    bad = rows.withColumn("text", F.when(F.col("dir") == "d5", F.raise_error(F.lit("no good"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no good"):
        write_tree(bad, str(tmp_path / "t"))
    assert not [f for f in listed(tmp_path) if "d" in f.split("/")[-2:][0]] and not os.path.exists(tmp_path / "t" / "_SUCCESS")
    write_tree(rows.filter("false"), str(tmp_path / "t"))
    assert listed(tmp_path / "t") == ["_SUCCESS"]


@pytest.mark.parametrize("name", ["../x", "/x", "a/../b", "", None, "a//b", "_aside-1/x"])
def test_names_stay_inside(name):
    with pytest.raises(ValueError):
        inside(name)
    assert inside("a/b.yml") == "a/b.yml"


def test_meta_is_read_back(spark, tmp_path):
    clean = spark.createDataFrame([("o/r", "0123456789abcdef", None, 1, ["perm"], 1, [("f.yml", "x", "y", "ok", [("perm", "a.b")], [])])], SCHEMAS["clean_fix_meta"])
    write_tree(meta_files(clean), str(tmp_path / "t"))
    (got,) = read_meta(spark, f"{tmp_path}/t/*/meta.json").collect()
    assert got.dir == "o__r__0123456789" and got.V_fixed_idents == ["perm"] and got.files[0].V_fixed[0].route == "a.b" and got.github_url is None
