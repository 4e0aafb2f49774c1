"""The entry point works without the training-data subpackage and without the libraries it needs."""

import subprocess
import sys

import pytest


@pytest.mark.parametrize("hidden", ["sentencepiece", "veritab.llm", "corpus_pipeline"])
def test_queries_without(hidden):
    code = (f"import sys; sys.modules[{hidden!r}] = None\n"
            "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n[:2] == 'op' and n[2].isdigit()), len(e.queries()))")
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    named, count = done.stdout.strip().rsplit(" ", 1)
    assert named == "[]" and int(count) > 80
