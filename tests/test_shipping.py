import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {here!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from granary import api
print("GROUPS", len(api.find_duplicates(spark, {tree!r})))
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    (tmp_path / "t").mkdir()
    for name in "ab":
        (tmp_path / "t" / name).write_text("same")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE.format(here=HERE, tree=str(tmp_path / "t"))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "GROUPS 1" in run.stdout, run.stderr[-2000:]
