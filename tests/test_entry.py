import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from claimloom.plans import catalogue

REPO = Path(__file__).parent.parent
WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("claimloom.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from claimloom.plans import catalogue
assert e.queries().keys() == catalogue.queries().keys() and e.oracle_sql().keys() == catalogue.oracle_sql().keys()
"""


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) <= set(entry.queries())


def test_entry_without_optional_parts():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=REPO, check=True, timeout=120)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {"relation_type", "rule_id", "n"} <= set(entry.entry(spark).columns) and len(rows) > 5
