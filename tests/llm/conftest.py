import pytest

from tallyline.llm.shared import prepare

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents from (doc_id, text) pairs."""
    prepare(spark)

    def build(rows, parts=3):
        full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(parts)

    return build
