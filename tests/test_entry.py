"""The entry without the folders that may be left out."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PRINT = "import __spark_entry__ as e; names = e.queries(); print(len(names), 'pipeline' in names, set(e.oracle_sql()) <= set(names))"


@pytest.mark.parametrize("left_out", [("forumgauge/llm", "corpus_pipeline.py"), ("forumgauge/llm",), ("corpus_pipeline.py",)])
def test_entry_without_the_training_data_operators(tmp_path, left_out):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in left_out:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", PRINT], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, pipeline, known = done.stdout.split()[-3:]
    assert int(count) >= 140 and (pipeline, known) == ("False", "True")


def test_a_fault_inside_is_not_hidden(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", "llm"))
    folder = copy / "forumgauge" / "llm"
    folder.mkdir()
    (folder / "__init__.py").write_text("")
    (folder / "queries.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", PRINT], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "no_such_module" in done.stderr
