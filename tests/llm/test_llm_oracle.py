import pytest

from tesserae.llm.queries import ORACLE, QUERIES
from tests.compare import check, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    check(spark, con, QUERIES[name], ORACLE[name])
