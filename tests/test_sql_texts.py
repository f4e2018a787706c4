"""The SQL side must build without Spark: no session, no jars."""

import subprocess
import sys
from pathlib import Path

CODE = """
import builtins, pathlib, zipfile
def closed(*a, **k): raise AssertionError("a file was opened while the SQL was built")
zipfile.ZipFile = closed
import __spark_entry__ as e
pathlib.Path.glob = closed
builtins.open = closed
from pyspark.sql import SparkSession
SparkSession.Builder.getOrCreate = closed
texts = e.oracle_sql()
assert len(texts) >= 150 and all(isinstance(t, str) and t.strip() for t in texts.values())
print(len(texts))
"""


def test_all_sql_builds_without_spark():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]


def test_stop_words_are_those_of_the_library(spark):
    from pyspark.ml.feature import StopWordsRemover

    from threadscope import presets

    assert sorted(presets.ENGLISH_STOP_WORDS) == sorted(w for w in StopWordsRemover.loadDefaultStopWords("english") if w)
