"""The driver's functions, with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names, sql = e.queries(), e.oracle_sql()
assert set(sql) <= set(names) and "dup_groups" in names, names
print("LEFT", sorted(n for n in names if n.startswith("op") or n == "pipeline"))
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("GROUPS", e.entry(spark).count())
"""


def test_names_and_sql_go_together():
    sys.path.insert(0, HERE)
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("pipeline_too", [False, True])
def test_queries_without_the_corpus_subpackage(tmp_path, pipeline_too):
    """The subpackage deleted; then the pipeline beside it too. In either case the other queries are there, and one runs."""
    repo = tmp_path / "repo"
    shutil.copytree(HERE, repo, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    if pipeline_too and os.path.exists(repo / "corpus_pipeline.py"):
        os.unlink(repo / "corpus_pipeline.py")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE], cwd=repo, env=env, capture_output=True, text=True, timeout=300)
    assert "LEFT []" in run.stdout and "GROUPS 7" in run.stdout, run.stderr[-2000:]


def test_queries_where_a_library_of_the_subpackage_is_missing():
    """The other queries are there, with a warning, if granary.llm can't be imported."""
    code = "import sys, warnings; sys.modules['zstandard'] = None; import __spark_entry__ as e\nwith warnings.catch_warnings(record=True) as w:\n    warnings.simplefilter('always')\n    names = e.queries()\nprint(len(names), sum(n.startswith('op') or n == 'pipeline' for n in names), len(w))"
    run = subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True, text=True, timeout=120)
    total, corpus, warned = map(int, run.stdout.split())
    assert total > 40 and corpus == 0 and (warned == 1 or not os.path.isdir(os.path.join(HERE, "granary", "llm"))), run.stderr[-500:]
