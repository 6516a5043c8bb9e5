"""The package runs when the driver is started from another folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from millrace.operators.knn import knn_impute
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false") \\
    .config("spark.driver.host", "127.0.0.1").getOrCreate()
df = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (2.1, None), (9.0, 90.0)], "a double, b double")
print("filled", sorted(r.b for r in knn_impute(df, ["a", "b"], 1).collect()))
"""


def test_knn_impute_from_another_folder(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(root=ROOT)], cwd=tmp_path, env=environment,
                          capture_output=True, text=True, timeout=240)
    assert "filled [10.0, 20.0, 20.0, 90.0]" in done.stdout, done.stderr[-2000:]
