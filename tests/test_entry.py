"""The driver's contract, with and without the optional subpackage."""

import ast
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("lodestone.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not [q for q in [*e.queries(), *e.oracle_sql()] if q == "pipeline" or q.startswith("op")]
"""


def test_entry_and_names(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["vec_id", "label", "score"] and rows.count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_training_data_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_the_library_does_not_import_the_training_data_operators():
    for path in (ROOT / "lodestone").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not [n for n in names if n.startswith("lodestone.llm") or n == "corpus_pipeline"], path
