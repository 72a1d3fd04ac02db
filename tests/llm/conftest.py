from pathlib import Path

import pytest

from tarazu.llm.tokens import DEFAULT_VOCABULARY

TRAIN = "row_id long, instruction string, input string, output string, source string, text string, n_tokens int, lang string, category string, topic_id int"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, domain string, topic_id int"


@pytest.fixture(scope="session")
def train(spark, data):
    return spark.read.parquet(f"{data}/train.parquet")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def make_train(spark):
    """Train rows from dicts; what isn't named is null."""
    names = [x.split()[0] for x in TRAIN.split(", ")]
    return lambda *rows: spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TRAIN)


@pytest.fixture(scope="session")
def make_documents(spark):
    names = [x.split()[0] for x in DOCUMENTS.split(", ")]
    return lambda *texts: spark.createDataFrame([tuple({"doc_id": k, "text": t, "source": "s"}.get(n) for n in names) for k, t in enumerate(texts)], DOCUMENTS)


@pytest.fixture(scope="session")
def vocabulary_path():
    if not Path(DEFAULT_VOCABULARY).exists():
        pytest.skip("no vocabulary here")
    return DEFAULT_VOCABULARY
