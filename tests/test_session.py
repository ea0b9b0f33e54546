"""The package reaches Python workers that don't start where it is."""

import subprocess
import sys
from pathlib import Path

HOME = Path(__file__).resolve().parent.parent
CODE = f"""
import sys
sys.path.insert(0, {str(HOME)!r})
from pyspark.sql import functions as F
from voxloom.functions.text import word_error_rate
from voxloom.session import local_session, ship_package
spark = local_session(1)
ship_package(spark)
ship_package(spark)
wer = F.pandas_udf(lambda a, b: a.combine(b, word_error_rate), "double")
print("WER", spark.createDataFrame([("a b", "a")], "x string, y string").select(wer("x", "y")).first()[0])
"""


def test_workers_elsewhere_get_the_package(tmp_path):
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "WER 0.5" in run.stdout, run.stderr[-2000:]
