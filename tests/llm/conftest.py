import pytest

from tests.llm.data import FOLDER, cases


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source")


@pytest.fixture(scope="session")
def rows(docs):
    return [tuple(r) for r in docs.orderBy("doc_id").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, ties, repeats and columns whose names clash with results."""
    return spark.createDataFrame(cases(), "doc_id long, text string, lang string, source string, kept string, spans long, size int, n_words string")
