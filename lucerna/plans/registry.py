"""All queries of the library proper."""

from __future__ import annotations

from . import evaluation, events, exchange, general_problems, retrieval

_MODULES = (general_problems, retrieval, evaluation, events, exchange)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
