"""Every operator query that has SQL against it, and all rows of the others, on the smallest tables."""

import pytest

from catalog.compare import connect, differences
from trailhead.llm import queries

from ..conftest import DATA

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, oracle, name):
    assert differences(spark, FOLDER, oracle, queries.queries()[name], queries.oracle_sql()[name]) is None


def test_numbers_are_complete():
    assert sorted(int(x[2:].split("_")[0]) for x in queries.queries()) == list(range(1, 14))
