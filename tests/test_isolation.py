"""The library without its corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import __spark_entry__ as e
found, sql = e.queries(), e.oracle_sql()
assert found and set(sql) <= set(found)
assert not [n for n in found if n == "pipeline" or n.startswith("op1")]
"""


@pytest.mark.parametrize("gone", [["weftscan/llm", "tests/llm"], ["weftscan/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_corpus_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))
    for name in gone:
        path = tmp_path / "repo" / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    # a folder left behind with nothing but caches is no subpackage
    (tmp_path / "repo/weftscan/llm/__pycache__").mkdir(parents=True)
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def _copy(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))
    for name in gone:
        path = tmp_path / "repo" / name
        shutil.rmtree(path) if path.is_dir() else path.unlink()
    return tmp_path / "repo"


def test_other_tests_pass_without_corpus_operators(tmp_path):
    repo = _copy(tmp_path, ["weftscan/llm", "tests/llm", "corpus_pipeline.py"])
    # those that need no minutes; all others import the same modules
    names = [f"tests/test_{n}.py" for n in ("functions", "sinks", "operators", "json_schema")]
    done = subprocess.run([sys.executable, "-m", "pytest", *names, "-x", "-q"], cwd=repo, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout[-3000:]


@pytest.mark.parametrize("package", ["public_tokenizers", "tokenizers", "xxhash", "regex"])
def test_entry_without_a_package_of_others(tmp_path, package):
    repo = _copy(tmp_path, [])
    hide = f"import sys; sys.modules['{package}'] = None\n"
    done = subprocess.run([sys.executable, "-c", hide + "import __spark_entry__ as e\nassert 'page_links' in e.queries() and 'page_links' in e.oracle_sql()"], cwd=repo, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_a_fault_inside_the_corpus_operators_is_not_hidden(tmp_path):
    repo = _copy(tmp_path, ["weftscan/llm/store.py"])
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=repo, capture_output=True, text=True)
    assert done.returncode != 0 and "weftscan.llm.store" in done.stderr
