import importlib.util

import pytest

if importlib.util.find_spec("cohortlab.llm") is None:
    collect_ignore_glob = ["test_*.py"]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text) as a table like ``documents``."""

    def make(rows, lang="en", source="s"):
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make
