"""Python task functions reach executors without an installed copy of the package."""

import os
import subprocess
import sys
import tempfile

SCRIPT = r'''
import sys
sys.path.insert(0, REPO)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from repolens.operators.pages import code_blocks
pages = spark.createDataFrame([("u", "<title>T · Issue #3 · o/r</title><div class='highlight'><pre>x = 1</pre></div>")],
                              "url string, html string")
print("ROWS", code_blocks(pages).count())
spark.stop()
'''


def test_mapinpandas_from_foreign_working_directory():
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory() as cwd:
        out = subprocess.run([sys.executable, "-c", f"REPO = {repo!r}\n" + SCRIPT], cwd=cwd, env=env,
                             capture_output=True, text=True, timeout=300)
    assert "ROWS 1" in out.stdout, out.stderr[-2000:]
