import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text), with a clashing extra column."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")

    return make
