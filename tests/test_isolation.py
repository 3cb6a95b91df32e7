"""The library without the subpackage llm, with and without the pipeline that builds on it."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
PROBE = """
import __spark_entry__ as e
from corpusloom.plans import catalogue
assert e.queries().keys() == catalogue.queries().keys() and e.oracle_sql().keys() == catalogue.oracle_sql().keys()
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0
"""


@pytest.mark.parametrize("gone", [["corpusloom/llm", "tests/llm"], ["corpusloom/llm", "tests/llm", "corpus_pipeline.py"]])
def test_without_llm(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *{Path(x).name for x in gone}))
    assert not any((copy / x).exists() for x in gone)
    run = subprocess.run([sys.executable, "-B", "-c", PROBE], cwd=copy, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-2000:]


def test_errors_inside_are_not_hidden(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    if not (copy / "corpusloom/llm").exists():
        pytest.skip("nothing to break")
    (copy / "corpusloom/llm/registry.py").write_text("import no_such_module\n")
    run = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; e.queries()"], cwd=copy, capture_output=True, text=True)
    assert run.returncode and "no_such_module" in run.stderr
