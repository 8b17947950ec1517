import pytest

from hearthline.packaging import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def documents(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS)

    return make
