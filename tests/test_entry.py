"""The registered queries, with and without what the corpus operators need."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


def counted(hidden: list[str]) -> list[str]:
    block = f"import sys; sys.modules.update(dict.fromkeys({hidden!r}))\n"
    said = subprocess.run([sys.executable, "-c", block + COUNT], cwd=TOP, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return said.stdout.split()


def test_the_rest_stands_without_the_corpus_operators():
    n = int(counted(["tidemark.llm", "corpus_pipeline"])[0])
    assert n > 110
    for hidden in (["public_tokenizers"], ["duckdb"], ["tidemark.llm"]):
        assert counted(hidden) == [str(n), "False", "False", "True"] or not (TOP / "tidemark/llm").exists()


def test_the_pipeline_alone_may_be_gone():
    assert counted(["corpus_pipeline"])[2] == "False"
