"""All registered queries of the core."""

from __future__ import annotations

from . import base, facts, labels, retrieval, streams, structure, texts  # noqa: F401


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.SQL)
