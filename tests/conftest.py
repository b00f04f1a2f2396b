import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("8")


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def make_docs(spark):
    """A corpus from (label, text) pairs, numbered from 0."""

    def make(pairs):
        rows = [(i, label, text) for i, (label, text) in enumerate(pairs)]
        return spark.createDataFrame(rows, "doc_id long, label string, text string")

    return make
