"""The entry without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if n in (".git", "llm", "__pycache__", ".pytest_cache")])
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'word_count' in q and 'pipeline' not in q and set(s) <= set(q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    os.remove(copy / "corpus_pipeline.py")
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, env=env).returncode == 0
