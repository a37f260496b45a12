import pytest

from shelfwise.llm.common import settle


@pytest.fixture(autouse=True)
def settled(spark):
    settle(spark)
