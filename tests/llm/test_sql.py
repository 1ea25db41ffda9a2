import pytest

from millrace.llm import registry
from tests import oracle


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    oracle.check(spark, sf_dir, registry.queries()[name], registry.oracle_sql()[name])


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
