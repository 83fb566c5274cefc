"""The driver's contract holds whatever the training-data operators need and the machine lacks."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = """
import sys
for name in {blocked!r}:
    sys.modules[name] = None  # importing it raises ImportError
import __spark_entry__ as E
from rollbook.plans.catalog import ORACLE_SQL, QUERIES
assert set(QUERIES) <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())
print(len(E.queries()) - len(QUERIES))
"""


def extra(blocked):
    done = subprocess.run([sys.executable, "-c", COUNT.format(blocked=blocked)], cwd=HERE, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return int(done.stdout)


def test_other_queries_outlive_a_failing_import():
    assert extra(["zstandard", "rollbook.llm.queries"]) == 0


def test_other_queries_outlive_absent_folders():
    assert extra(["rollbook.llm", "corpus_pipeline"]) == 0
