import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from chronofold.llm.ship import ship  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from texts or (doc_id, text[, source]) tuples."""
    ship(spark)

    def make(*rows):
        full = []
        for number, row in enumerate(rows):
            if not isinstance(row, tuple):
                row = (number, row)
            name, text, *rest = row
            source = rest[0] if rest else "src1"
            full.append((name, text, "en", source, len(text or "")))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
