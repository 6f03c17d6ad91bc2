"""Queries run where the executors can't import the package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
for name in ("op8_learned_ann", "op10_language_id", "op9_quality", "op6_packing"):
    assert entry.queries()[name](spark, sys.argv[2]).count() > 0, name
print("all ran")
"""


def test_models_travel_by_value(tmp_path, sf_dir):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script), str(ROOT), sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert "all ran" in done.stdout, done.stderr[-2000:]
