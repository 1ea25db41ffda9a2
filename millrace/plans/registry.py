"""All queries of the library outside of the training-data subpackage."""

from __future__ import annotations

from . import evaluation, ingestion, layout, monitoring, retrieval, traces

_ALL = retrieval.QUERIES | monitoring.QUERIES | evaluation.QUERIES | ingestion.QUERIES | traces.QUERIES | layout.QUERIES


def queries() -> dict:
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
