"""Queries of the library by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from marlstone.plans import facts, risk, service, text

_MODULES = (facts, risk, text, service)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
