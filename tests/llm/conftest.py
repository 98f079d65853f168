import pytest

from tidemark.llm.common import clear_written


@pytest.fixture(scope="session", autouse=True)
def cleared(spark):
    yield
    clear_written(spark)
