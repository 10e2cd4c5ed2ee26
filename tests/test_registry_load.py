"""The registry loads without any file beside the package, and functions that
run in tasks do not need the package on the workers' path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

LOAD = """
import builtins, glob, zipfile
glob.glob = lambda *a, **k: []
def refuse(*a, **k):
    raise AssertionError("file access at load")
zipfile.ZipFile = refuse
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert len(q) >= 115 and set(s) <= set(q)
print("LOADED", len(q))
"""

RUN = """
import sys
sys.path.insert(0, {repo!r})
from gradeflow.session import local_session
spark = local_session(2)
import __spark_entry__ as e
for name in ("N4_quantile_normal", "K7_keyword_attention"):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").limit(5).count() > 0
print("RAN")
"""


def _run(code, cwd):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run(
        [sys.executable, "-c", code.format(repo=REPO)], cwd=cwd, env=env, capture_output=True, text=True, timeout=600
    )


def test_registry_loads_without_files(tmp_path):
    out = _run(LOAD, tmp_path)
    assert "LOADED" in out.stdout, out.stderr[-2000:]


def test_arrow_functions_run_from_another_folder(tmp_path):
    out = _run(RUN, tmp_path)
    assert "RAN" in out.stdout, out.stderr[-2000:]


def test_test_files_have_names_of_their_own():
    from pathlib import Path

    names = [p.name for p in Path(__file__).parent.rglob("test_*.py")]
    assert len(names) == len(set(names))
