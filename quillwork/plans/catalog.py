"""Registered queries of the linkage engine."""

from __future__ import annotations

from . import linking, listing, meaning, reviewing

_MODULES = (listing, linking, reviewing, meaning)


def queries():
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
