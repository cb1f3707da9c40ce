import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, id string, kind string, slot string"


@pytest.fixture()
def docs(spark):
    """Documents with nulls, empty and repeated rows, and extra columns whose names clash with inner ones."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, None if t is None else "en", f"src{n % 5}", None, 1, "x", "y", "z") for n, (i, t) in enumerate(zip(ids, texts))], SCHEMA)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.001"
