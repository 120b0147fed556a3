"""The driver contract with and without the optional subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
{block}
import __spark_entry__ as e
names = set(e.queries())
assert set(e.oracle_sql()) <= names
print(len([n for n in names if n == "pipeline" or n.startswith("op") and n[2].isdigit()]), "feature_panel" in names)
"""


def registered(block: str) -> str:
    code = CODE.format(root=ROOT, block=block)
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()


def test_without_the_subpackage():
    for missing in ("corpus_pipeline", "panelspark.llm"):
        assert registered(f"sys.modules[{missing!r}] = None") == ["0", "True"]


def test_other_import_errors_are_not_swallowed():
    code = CODE.format(root=ROOT, block="sys.modules['panelspark.catalog.rules'] = None")
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode != 0


def test_without_a_library_of_the_optional_half():
    assert registered("sys.modules['public_tokenizers'] = None") == ["0", "True"]
    code = CODE.format(root=ROOT, block="sys.modules['pyspark.ml'] = None")
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode != 0
