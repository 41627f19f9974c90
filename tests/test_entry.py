"""The driver's entry point, with and without the optional part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHECK = """
import sys
{before}
import __spark_entry__ as entry
names = set(entry.queries())
assert {{"q_apply_mapping", "q_run_ingestion", "q_profile"}} <= names
assert not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(entry.oracle_sql()) <= names
"""


def run(folder, before=""):
    done = subprocess.run([sys.executable, "-c", CHECK.format(before=before)], cwd=folder, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def copy(to, *left_out):
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *left_out))
    return to


def test_entry_without_the_optional_folders(tmp_path):
    bare = copy(tmp_path / "bare", "llm", "corpus_pipeline.py")
    run(bare)
    os.makedirs(bare / "quaymaster" / "llm" / "__pycache__")  # what a deletion may leave
    run(bare)


def test_entry_when_only_the_subpackage_is_gone(tmp_path):
    run(copy(tmp_path / "half", "llm"))


def test_entry_without_a_library_of_the_optional_part(tmp_path):
    run(copy(tmp_path / "poor", "corpus_pipeline.py"), "sys.modules['xxhash'] = None")
