import pytest

from sparkcell.llm import queries
from tests.compare import agrees


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    agrees(spark, queries.queries()[name], queries.oracle_sql()[name])
