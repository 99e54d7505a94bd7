"""The entry without the corpus subpackage, in a copy of the repository."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2:3].isdigit() or n == 'pipeline' for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_entry_without_corpus_folders(tmp_path, pipeline_too):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    if pipeline_too:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=False)
    assert out.returncode == 0, out.stderr[-1500:]
    count, corpus, oracles = out.stdout.split()
    assert int(count) > 150 and corpus == "False" and oracles == "True"


def test_another_missing_module_is_an_error(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    (copy / "corpus_pipeline.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=False)
    assert out.returncode != 0 and "no_such_module" in out.stderr
