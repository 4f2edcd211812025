"""Every operator as a query over the common tables, beside independent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    from lodestone.catalog import checks, data, flows, intake, models, records, rules  # noqa: F401

    return dict(QUERIES), dict(SQL)
