import pytest

from millrace.plans import registry
from tests import oracle

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    oracle.check(spark, sf_dir, registry.queries()[name], SQL[name])


def test_every_query_has_a_docstring():
    assert all(q.__doc__ for q in registry.queries().values())


def test_entry_module_without_the_training_data_operators(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("millrace.llm", "corpus_pipeline") else found(name, *a))
    assert set(entry.queries()) == set(registry.queries())
    assert set(entry.oracle_sql()) == set(SQL)
