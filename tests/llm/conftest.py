import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import ROWS  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    """The rows with columns whose names operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string, digest string, ws string, hits string"
    return spark.createDataFrame([(d, t, None, "s", None, "k", "f", "d", "w", "h") for d, t in ROWS], schema)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
