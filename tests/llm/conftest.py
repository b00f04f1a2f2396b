import random

import pytest

WORDS = [a + b for a in "ban cor del fim gus hop jal kem".split() for b in "ado ine ulo eta opi".split()]


@pytest.fixture(scope="session")
def prose():
    """``prose(seed, words)``: the same invented text for the same seed."""

    def make(seed, words):
        return " ".join(random.Random(seed).choices(WORDS, k=words))

    return make


@pytest.fixture(scope="session")
def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
