import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def run(code, cwd=ROOT):
    return subprocess.run([sys.executable, "-c", code], cwd=cwd, capture_output=True, text=True)


def test_entry_module_imports_without_a_session():
    done = run("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'grid_pivot' in q; print(len(q))")
    assert done.returncode == 0, done.stderr


def test_entry_works_without_the_training_data_package(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tallyspark", tmp_path / "tallyspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = run("import __spark_entry__ as e; q = e.queries(); assert 'grid_pivot' in q and not any(n.startswith('op') for n in q)", tmp_path)
    assert done.returncode == 0, done.stderr
