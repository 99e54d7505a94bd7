"""Functions that run in Python find the package on workers that do not have it on their path."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from sparkloom.functions import json
from sparkloom.fts.index import Index
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.createDataFrame([(1, '{{"a": [1, 2]}}', 'running dogs')], 'id int, j string, t string')
assert df.select(json.contains(F.col('j'), F.lit('{{"a": [2]}}'))).first()[0]
assert {{r['term'] for r in Index.build(df, 'id', 't').postings.collect()}} == {{'run', 'dog'}}
print('found')
"""


def test_python_functions_without_the_path(tmp_path):
    out = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, capture_output=True, text=True, check=False, timeout=200)
    assert "found" in out.stdout, out.stderr[-2000:]
