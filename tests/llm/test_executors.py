"""Executors that have no copy of this package."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,2048]").config("spark.executor.memory", "2g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") and "_" in name and name[2].isdigit():
        print(name, len(query(spark, "/root/testdata/sf0.001").collect()), flush=True)
"""


def test_all_ten_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "shared").mkdir()
    # As a file and not by -c: Spark's workers then start with no path of the driver's.
    (tmp_path / "main.py").write_text(SCRIPT)
    done = subprocess.run([sys.executable, "main.py", repo, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    assert len(done.stdout.split("\n")) >= 10
