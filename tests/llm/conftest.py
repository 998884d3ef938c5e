import pytest


@pytest.fixture()
def docs(spark):
    """``docs(rows)``: a documents table with a clashing extra column."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", s, 7) for i, t, s in rows],
            "doc_id long, text string, lang string, source string, size int")
    return make
