"""All registered queries and the SQL that states their results."""

from __future__ import annotations

from catalog import graphs, history, learning, tables

_PARTS = [history, tables, graphs, learning]


def queries():
    return {k: v for part in _PARTS for k, v in part.queries().items()}


def oracle_sql():
    return {k: v for part in _PARTS for k, v in part.oracle().items()}
