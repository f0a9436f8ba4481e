import pytest

from tesserae.plans.registry import ORACLE, QUERIES
from tests.compare import FOLDER, check, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    check(spark, con, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs_and_repeats(spark, name):
    first, again = (QUERIES[name](spark, FOLDER) for _ in range(2))
    rows = sorted(map(str, first.collect()))
    assert rows and rows == sorted(map(str, again.collect()))
