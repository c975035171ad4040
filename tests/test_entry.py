"""The registered queries stand without the optional llm folder."""

import pathlib
import subprocess
import sys

import __spark_entry__ as entry
from ledgerloom.plans.catalog import QUERIES

ROOT = pathlib.Path(__file__).resolve().parents[1]
BLOCKED = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("ledgerloom.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from ledgerloom.plans.catalog import QUERIES, TWINS
assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(TWINS)
"""


def test_every_oracle_has_a_query():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_llm_folder():
    subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, check=True, timeout=120)
