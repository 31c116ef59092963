"""The entry points stand without the text operators and without packages that only these need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("absent", ["zstandard", "scriptoria.llm", "corpus_pipeline", "public_tokenizers"])
def test_entry_without(absent):
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'a01_page_score' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=300)
