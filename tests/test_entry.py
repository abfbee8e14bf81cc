import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

GONE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "graphloom.llm" or name.startswith("graphloom.llm.") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(q.startswith("op") or q == "pipeline" for q in e.queries())
print("fine")
"""


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_operators():
    out = subprocess.run([sys.executable, "-c", GONE], cwd=ROOT, capture_output=True, text=True)
    assert out.stdout.strip() == "fine", out.stderr


def test_nothing_else_imports_the_operators():
    for path in (ROOT / "graphloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "graphloom").parts:
            assert "graphloom.llm" not in path.read_text(), path
