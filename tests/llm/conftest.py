import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Make documents from (doc_id, text) pairs, with columns whose names operators use inside."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x", "y", 1.0) for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, cls string, key string, score double").repartition(3)

    return make
