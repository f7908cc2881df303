"""The entry module from a foreign folder, and without the optional parts."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code: str, folder, root: str = ROOT) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    head = f"import sys; sys.path.insert(0, {root!r})\n"
    done = subprocess.run([sys.executable, "-c", head + code], cwd=folder, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_python_workers_get_the_package(tmp_path):
    out = run(
        "from suite.compare import session\nimport __spark_entry__ as e\n"
        "print('ROWS', e.queries()['knn_candidates_exact'](session(2), '/root/testdata/sf0.001').count())", tmp_path)
    assert int(out.split("ROWS ")[1]) > 0


def test_entry_without_the_optional_parts(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse"))
    out = run("import __spark_entry__ as e\nprint('N', len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())", tmp_path, str(copy))
    assert out.split("N ")[1].split()[2] == "False"
