import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs(spark):
    """Documents, with columns whose names clash with the operators' own."""

    def make(rows, lang=None):
        schema = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, score double, component string, h string"
        return spark.createDataFrame([(i, t, (lang or {}).get(i), "web", len(t or ""), "k", "x", 0.5, "c", "h") for i, t in rows], schema)

    return make
