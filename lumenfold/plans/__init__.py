"""Named queries over the test tables and the SQL that checks them."""

from __future__ import annotations

from .base import ORACLES, QUERIES


def _load() -> None:
    from . import audits, documents, models, tables  # noqa: F401


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
