import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parent.parent


def test_entry_without_the_training_data_operators():
    code = "import sys; sys.modules['cairnflow.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'contrastive_pairs' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=TOP, check=True, timeout=120)


def test_nothing_else_imports_them():
    for path in [*TOP.glob("cairnflow/**/*.py"), TOP / "bench.py"]:
        if "llm" not in path.parts:
            assert "llm" not in path.read_text().replace("__spark_entry__", ""), path
