"""The entry module with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
from fundweave.plans import catalogue
assert e.queries().keys() == catalogue.QUERIES.keys()
assert e.oracle_sql() == catalogue.ORACLE_SQL
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() > 0
print("queries", len(e.queries()))
"""


def _copy(tmp_path, *without):
    skip = shutil.ignore_patterns(".git", "__pycache__", "tests", *without)
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    return tmp_path / "copy"


def _run(folder, script):
    return subprocess.run([sys.executable, "-B", "-c", script], cwd=folder, capture_output=True, text=True, timeout=300, check=False)


def test_without_the_subpackage(tmp_path):
    found = _run(_copy(tmp_path, "llm"), SCRIPT)
    assert found.returncode == 0, found.stderr
    assert "queries" in found.stdout


def test_without_the_subpackage_and_the_pipeline(tmp_path):
    found = _run(_copy(tmp_path, "llm", "corpus_pipeline.py"), SCRIPT)
    assert found.returncode == 0, found.stderr


def test_a_missing_library_of_the_subpackage_leaves_the_rest(tmp_path):
    folder = _copy(tmp_path)
    (folder / "xxhash.py").write_text("raise ImportError('no such library')\n")
    found = _run(folder, SCRIPT.replace("catalogue.QUERIES.keys()\n", "catalogue.QUERIES.keys(), sorted(e.queries().keys() ^ catalogue.QUERIES.keys())\n"))
    # Without its hash library the subpackage, or in a tree without it nothing, is left out.
    assert found.returncode == 0, found.stderr
