import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with an extra column whose name clashes with an inner one."""

    def make(*texts, first=0):
        rows = [(first + i, t, "x", "s", 0) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, key string, sig string, n_words int")

    return make
