"""The library's queries are there whatever the corpus part lacks."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import sys
sys.path.insert(0, {root!r})
sys.modules[{absent!r}] = None  # imports of it fail
import __spark_entry__ as entry
import queryset
print("library", set(queryset.QUERIES) == set(entry.queries()), set(queryset.ORACLES) == set(entry.oracle_sql()))
"""


@pytest.mark.parametrize("absent", ["public_tokenizers", "millrace.llm", "corpus_pipeline"])
def test_library_without_the_corpus_part(tmp_path, absent):
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(root=ROOT, absent=absent)], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "library True True" in done.stdout, done.stderr[-2000:]
