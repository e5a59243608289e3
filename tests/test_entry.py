import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_core_stands_without_the_text_operators():
    code = "import sys; sys.modules['saltmarsh.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_imports_the_text_operators():
    for p in (ROOT / "saltmarsh").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "saltmarsh.llm" not in p.read_text(), p


def test_every_sql_has_its_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
