"""The driver's entry without the optional parts."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("hidden", ["public_tokenizers", "paywarden.llm", "corpus_pipeline"])
def test_engine_queries_stay(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), sum(n[:2] == 'op' and n[2].isdigit() for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 40 and int(out[1]) > 40 and int(out[2]) in ((10, 0) if hidden == "corpus_pipeline" else (0,))
