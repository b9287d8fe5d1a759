import pytest

from sparkcell.plans.catalog import QUERIES
from tests.compare import SF, agrees


@pytest.mark.parametrize("name", [k for k, (_, sql) in QUERIES.items() if sql])
def test_agrees_with_sql(spark, name):
    agrees(spark, *QUERIES[name])
