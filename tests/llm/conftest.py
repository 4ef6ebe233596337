import pytest

from flowboard.llm.common import on_workers

@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    on_workers(spark)


@pytest.fixture(scope="session")
def make(spark):
    def build(rows, schema="doc_id bigint, text string"):
        return spark.createDataFrame(rows, schema)

    return build
