"""The entry module must load wherever Spark's files lie."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import pyspark
pyspark.__file__ = "/nowhere/pyspark/__init__.py"
import __spark_entry__ as entry
from broadsheet import catalog
assert len(catalog.QUERIES) >= 62
assert set(catalog.QUERIES) <= set(entry.queries())
assert set(entry.oracle_sql()) <= set(entry.queries())
"""


def test_import_without_spark_files():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, capture_output=True,
                          text=True, timeout=120)
    assert done.returncode == 0, done.stderr


BLOCKED = """
import sys
sys.modules[sys.argv[1]] = None
import __spark_entry__ as entry
from broadsheet import catalog
assert set(entry.queries()) == set(catalog.QUERIES) and len(catalog.QUERIES) >= 62
assert set(entry.oracle_sql()) == set(catalog.ORACLES)
"""


@pytest.mark.parametrize("name", ["ahocorasick", "public_tokenizers", "corpus_pipeline"])
def test_import_without_an_optional_package(name):
    """Only the training-data queries go."""
    done = subprocess.run([sys.executable, "-c", BLOCKED, name], cwd=ROOT, capture_output=True,
                          text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_a_missing_module_of_the_rest_is_a_fault():
    done = subprocess.run([sys.executable, "-c", BLOCKED, "broadsheet.sources.tables"], cwd=ROOT,
                          capture_output=True, text=True, timeout=120)
    assert done.returncode != 0


def test_stop_words_are_those_of_spark(spark):
    from pyspark.ml.feature import StopWordsRemover

    from broadsheet import constants as C
    assert list(C.STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")
