from __future__ import annotations

import pytest

from tidemark.llm import lines


@pytest.fixture(autouse=True)
def few_cells(monkeypatch):
    """Fewer hash cells for the words of small tables: more words share one, and tests are faster."""
    monkeypatch.setattr(lines, "CELLS", 1 << 13)
